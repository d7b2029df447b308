import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from retailops.llm import bpe, token_counts
from retailops.llm.common import documents

from .cases import SF, empty_documents, odd_documents

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_published_one():
    assert bpe.PATTERN == P.PATTERN


def random_texts(n):
    rnd = random.Random(3)
    letters = "ab \n\t  e'st 　é中\U0001d11e1 2!\x1c\x85ſ .,"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_codec_equals_library_on_random_texts(library):
    c = bpe.Codec(bpe.read_ranks(RANKS))
    texts = random_texts(3000) + ["a" * 4001, " " * 301, "aaaa" * 77 + " aaaaa", "abababab" * 99]
    ids, n = c.encode(texts)
    want = [library.encode_ordinary(t) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert c.decode(ids, n)[0].tobytes() == "".join(texts).encode()


def test_words_redone_one_merge_at_a_time_are_the_same(library):
    c = bpe.Codec(bpe.read_ranks(RANKS))
    words = [w.encode() for w in ("hello", " aaaaaaa", "the", "été")]
    ids, n = c.replay(words)
    again, m = c._redo(words, ids, n, np.arange(len(words)))
    assert ids.tolist() == again.tolist() and n.tolist() == m.tolist()


def test_piece_table_is_bounded_and_results_stay():
    c = bpe.Codec(bpe.read_ranks(RANKS))
    c.pieces.limit = 5
    a = [c.encode([t])[0].tolist() for t in random_texts(50)]
    assert a == [bpe.codec(bpe.read_ranks(RANKS), P.PATTERN).encode([t])[0].tolist() for t in random_texts(50)]


@pytest.mark.parametrize("make", [odd_documents, lambda s: documents(s, SF)])
def test_digest(spark, library, make):
    docs = make(spark)
    want = sorted((str(r.doc_id), len(i := library.encode_ordinary(r.text or "")),
                   hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(),
                   hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    got = sorted((str(r[0]), *r[1:]) for r in bpe.digest(docs, RANKS).collect())
    assert got == want


def test_encode_then_decode(spark):
    docs = odd_documents(spark)
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted(
        (str(r.doc_id), (r.text or "").encode()) for r in docs.collect())
    assert bpe.digest(empty_documents(spark), RANKS).count() == 0


def test_rank_file_size_is_checked(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_RANK_FILE", 10)
    (tmp_path / "r").write_bytes(b"x" * 11)
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "r"))


@pytest.mark.parametrize("make", [odd_documents, lambda s: documents(s, SF)])
def test_counts_equal_library(spark, make):
    docs, t = make(spark), Tokenizer.from_file(JSON)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids),
                   n > 1024) for r in docs.select("doc_id", "text").collect())
    assert sorted((str(r[0]), *r[1:]) for r in token_counts.token_counts(docs, JSON).collect()) == want
    assert token_counts.token_counts(empty_documents(spark), JSON).count() == 0


def test_counter_on_random_texts():
    t, c = Tokenizer.from_file(JSON), token_counts.counter(open(JSON, "rb").read())
    texts = random_texts(2000) + ["<|endoftext|>", "a <|endoftext|> <|endoftext|>b", "aaaa" * 500]
    want = [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    assert c.count(texts).tolist() == want
    c.rising = False  # the general path: one pair of a sequence at a time
    c.pieces.ids.clear()
    c.pieces.unsafe.clear()
    c._reset()
    assert c.count(texts[:300]).tolist() == want[:300]
    c.rising = True
