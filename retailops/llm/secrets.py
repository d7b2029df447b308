"""Secret scans through a trigram inverted index.

Method.  From each rule's regular expression a Boolean trigram query is derived: alternatives (OR) of trigrams that any
match must hold (AND).  The index has a posting (trigram, document) for each trigram that a query names and a text
holds, ASCII letters in lower case.  Intersecting postings gives the candidates of each rule; only candidates are
verified with the expression itself.  A rule with an alternative that has no mandatory trigram scans every document.

Scale.  Postings carry no text and are combined per task before they are exchanged.  The text is exchanged once, to meet
its candidate rules, under a key of the whole row, so NULL ids spread; adaptive execution splits copies of one row.  The
rule table is bounded by the rules given.  All of it is DataFrame work.

Defined results: NULL text is empty and has no spans; repeated rows each give a row; an empty table gives an empty table;
columns other than the id and the text are not read.  Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern``: a Java expression; ``group``/``least``: that group must have so many characters, else the match is
    dropped after it has taken its text."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Base rules (fixed by contract), in the order that breaks ties.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further rules: published formats of key headers and tokens.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
MAX_WAYS, MAX_CLASS = 64, 8
SUMMED = 256  # lengths added up in one array


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory lower-case trigrams; None if some match needs none."""
    ways = _ways(parser.parse(pattern), [((), "")])
    found = []
    for done, open_ in ways:
        grams = frozenset(s[i:i + 3] for s in (*done, open_) for i in range(len(s) - 2))
        if not grams:
            return None
        found.append(grams)
    return [g for g in dict.fromkeys(found) if not any(h < g for h in found)]


def _gap(ways):
    return list(dict.fromkeys(((*d, o) if o else d, "") for d, o in ways))


def _ways(items, ways):
    """Ways to pass ``items``: (literal runs that ended, literal run that is open), one entry per alternative."""
    for op, arg in items:
        if op is C.LITERAL:
            ways = [(d, o + chr(arg).lower()) for d, o in ways]
        elif op is C.IN and (chars := _small_class(arg)) and len(chars) * len(ways) <= MAX_WAYS:
            ways = [(d, o + c) for d, o in ways for c in chars]
        elif op is C.SUBPATTERN:
            ways = _ways(arg[3], ways)
        elif op is C.BRANCH:
            split = [w for branch in arg[1] for w in _ways(branch, ways)]
            ways = split if len(split) <= MAX_WAYS else _gap(ways)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = arg
            if (least, most) == (0, 1) and 2 * len(ways) <= MAX_WAYS:
                ways = list(dict.fromkeys(ways + _ways(body, ways)))
            elif least:
                ways = _gap(_ways(body, ways))
            else:
                ways = _gap(ways)
        elif op not in (C.AT, C.ASSERT, C.ASSERT_NOT):  # places and look-arounds take no text
            ways = _gap(ways)
    return list(dict.fromkeys(ways))


def _small_class(items) -> list[str]:
    chars: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            chars.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < MAX_CLASS:
            chars.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return []
    return sorted(chars) if len(chars) <= MAX_CLASS else []


def trigram_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of the trigrams asked for; ``texts`` has key and text."""
    folded = texts.select("key", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("t"))
    grams = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda g: F.contains("t", g))
    return folded.select("key", F.explode(grams).alias("trigram")).distinct()


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, kinds) of the documents whose postings satisfy a query of that kind."""
    rows = [(kind, way, t, len(ts)) for kind, ways in queries.items() for way, ts in enumerate(ways) for t in sorted(ts)]
    need = postings.sparkSession.createDataFrame(rows, "kind string, way int, trigram string, need int")
    met = postings.join(F.broadcast(need), "trigram").groupBy("key", "kind", "way").agg(
        F.count("*").alias("n"), F.first("need").alias("need")).filter("n = need")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))  # at most one entry per rule


def steps(text: Column, rule: Rule) -> Column:
    """Lengths (w: whole, g: gap, h: the counted group) of the steps through a text.

    Each step matches the text before a match and the match itself, or the rest of the text, so lengths add up to
    positions.  Matches are the leftmost ones that do not overlap.
    """
    walk = F.lit(rf"(?s)(.*?)(?:{rule.pattern}|\z)")
    size = lambda group: F.transform(F.regexp_extract_all(text, walk, F.lit(group)), F.length)
    found = F.arrays_zip(size(0).alias("w"), size(1).alias("g"), size(rule.group + 1 if rule.group else 0).alias("h"))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast("array<struct<w:int,g:int,h:int>>"))


def _sums(lengths: Column) -> Column:
    """0 and the running sums of an array; it grows in each step, so only short arrays are summed this way."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def block_sums(lengths: Column) -> Column:
    """``_sums`` of every ``SUMMED`` lengths."""
    last = F.floor((F.size(lengths) - 1) / F.lit(SUMMED)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(lengths, b * SUMMED + 1, SUMMED))
    return F.transform(cut, _sums)


def spans(found: Column, sums: Column, rule: Rule) -> Column:
    """Array of (kind, start, end) of the rule's matches from its steps and the sums of their blocks: linear in the steps."""
    before = _sums(F.transform(sums, lambda x: F.element_at(x, -1)))
    begin = F.flatten(F.transform(F.arrays_zip(sums.alias("x"), F.slice(before, F.lit(1), F.size(sums)).alias("b")), lambda z: F.transform(
        F.slice(z["x"], F.lit(1), F.size(z["x"]) - 1), lambda v: v + z["b"])))
    all_ = F.arrays_zip(begin.alias("at"), found.alias("s"))
    kept = F.filter(all_, lambda z: (z["s"]["w"] > z["s"]["g"]) & (z["s"]["h"] >= rule.least))
    return F.transform(kept, lambda z: F.struct(F.lit(rule.kind).alias("kind"), (z["at"] + z["s"]["g"]).alias("start"),
                                                (z["at"] + z["s"]["w"]).alias("end")))


def find(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans_<kind> ...) per document."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q}
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")) \
        .withColumn("key", row_key("id", "text"))
    postings = trigram_index(texts.select("key", "text"), sorted(set().union(*(t for q in asked.values() for t in q))))
    met = texts.join(candidates(postings, asked).hint("shuffle_hash"), "key", "left")
    none = F.array().cast("array<struct<w:int,g:int,h:int>>")
    met = met.select("id", "text", *[
        (F.when(F.array_contains("kinds", r.kind), steps(F.col("text"), r)).otherwise(none) if r.kind in asked else steps(F.col("text"), r))
        .alias(f"steps_{r.kind}") for r in rules])
    met = met.select("*", *[block_sums(F.col(f"steps_{r.kind}.w")).alias(f"sums_{r.kind}") for r in rules])
    return met.select(F.col("id").alias(id_col), "text", *[
        spans(F.col(f"steps_{r.kind}"), F.col(f"sums_{r.kind}"), r).alias(f"spans_{r.kind}") for r in rules])


def _joined(rules: tuple[Rule, ...]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    every = F.concat(*[F.transform(f"spans_{r.kind}", lambda x, i=i: F.struct(
        x["start"].alias("start"), F.lit(i).alias("nth"), x["kind"].alias("kind"), x["end"].alias("end")))
        for i, r in enumerate(rules)])
    return F.array_join(F.transform(F.sort_array(every), lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = find(docs)
    return found.select("doc_id", *[F.size(f"spans_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in BASE],
                        F.sha2(_joined(BASE), 256).alias("base_sha256"), _joined(BASE + MORE).alias("spans"))
