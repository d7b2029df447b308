"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op4_line_dedup"] = r"""
with d as (select row_number() over () as r, * from documents),
lines as (select r, source, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as pos from d),
trimmed as (select *, regexp_replace(regexp_replace(raw, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') as line from lines),
wide as (select line from trimmed where length(line) >= 1 group by line having count(distinct coalesce(source, chr(0))) >= 8),
texts as (select r, any_value(source) as source, string_agg(line, chr(10) order by pos) as whole from trimmed group by r),
copies as (select whole from texts group by whole having count(distinct coalesce(source, chr(0))) >= 8),
marked as (select r, pos, raw, line in (select line from wide) as gone from trimmed),
left_ as (select r, count(*) as n, count(*) filter (gone) as g, coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '') as new
          from marked group by r),
final as (select d.doc_id, n, coalesce(g > 0 and whole not in (select whole from copies), false) as cut, g, new, text
          from d left join left_ using (r) left join texts using (r))
select doc_id, coalesce(n, 0)::bigint as n_lines, (case when cut then g else 0 end)::bigint as n_removed,
       length(coalesce(case when cut then new else text end, ''))::bigint as left_chars,
       md5(coalesce(case when cut then new else text end, '')) as left_md5
from final
"""

#: crc32 of the bytes of a string of code points below 2048, as a DuckDB expression over the table ``crc(t)``.
CRC_TABLE = """crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i))"""


def crc32(text: str) -> str:
    codes = (f"flatten(list_transform(string_split({text}, ''), lambda ch: case when unicode(ch) < 128 then [unicode(ch)::bigint] "
             "else [192 + (unicode(ch) >> 6)::bigint, 128 + (unicode(ch) & 63)::bigint] end))")
    return f"xor(list_reduce([4294967295] || {codes}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


ORACLES["op11_spelling_variants"] = rf"""
with recursive {CRC_TABLE},
runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents),
counted as (select id, run, count(*) as n from runs where length(run) >= 5 group by all),
hashed as (select run, n, {crc32("id || ':' || run")} as h from counted, crc),
altered as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n
            from hashed),
v as materialized (select word, sum(n)::bigint as n from altered where length(word) >= 5 group by word having sum(n) >= 3),
dels as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as s
                      from (select word, n, unnest(range(1, length(word) + 1))::int as i from v)),
near as (select d.word, v.word as other, v.n as other_n from dels d join v on v.word = d.s
         union select v.word, d.word, d.n from dels d join v on v.word = d.s
         union select a.word, b.word, b.n from dels a join dels b on a.i = b.i and a.s = b.s and a.word <> b.word),
best as (select word, count(*) as n_near, min(struct_pack(n := -other_n, w := other)) as b from near group by word),
formed as materialized (select word, v.n, coalesce(n_near, 0)::bigint as n_near, case when -b.n >= 2 * v.n then b.w end as form,
                               case when -b.n >= 2 * v.n then -b.n end as form_n from v left join best using (word)),
walk(word, reached, form) as (select word, word, form from formed
         union all select w.word, w.form, f.form from walk w join formed f on f.word = w.form)
select f.word, f.form, w.reached as root, f.n, f.n_near, f.form_n from formed f join walk w on w.word = f.word and w.form is null
"""


def merkle_levels(leaf: str, proof: str, tag: str, levels: int) -> str:
    """CTEs that build a tree of ``levels`` levels over ``leaf`` (s, n, i, d) and carry ``proof`` (k, s, n, pos, path, cur) up through it."""
    out = []
    for h in range(1, levels + 1):
        nodes, walk = (leaf, proof) if h == 1 else (f"{tag}{h - 1}", f"{tag}p{h - 1}")
        out.append(f"""{tag}r{h} as (select s, n, i // 3 as i, list(d order by i) as ds from {nodes} group by s, n, i // 3),
{tag}{h} as materialized (select s, (n + 2) // 3 as n, i, case when n > 1 then sha256(array_to_string(ds, '')) else ds[1] end as d from {tag}r{h}),
{tag}p{h} as materialized (select k, p.s, (p.n + 2) // 3 as n, pos // 3 as pos,
  path || case when p.n > 1 then array_to_string(ds[1:pos % 3], '') || array_to_string(ds[pos % 3 + 2:], '') else '' end as path,
  case when p.n > 1 then sha256(array_to_string(ds[1:pos % 3], '') || cur || array_to_string(ds[pos % 3 + 2:], '')) else cur end as cur
  from {walk} p join {tag}r{h} r on r.s = p.s and r.i = p.pos // 3)""")
    return ",\n".join(out)


#: Levels that the SQL of the manifest writes out: up to 3 ** 10 documents a source and 3 ** 6 sources.
SOURCE_LEVELS, TOP_LEVELS = 10, 6
_ENCODED = [f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{}")]
_LEAF = "sha256(" + " || ".join(_ENCODED) + ")"

ORACLES["op12_merkle_manifest"] = rf"""
with {CRC_TABLE},
base as (select *, coalesce({crc32("doc_id::varchar")}, 0) % 2 = 0 as hit from documents, crc),
leaves as (select coalesce('=' || source, '') as s, doc_id, {_LEAF.replace("{}", "text")} as leaf,
                  case when hit then {_LEAF.replace("{}", "replace(text, chr(10), '')")} else {_LEAF.replace("{}", "text")} end as tampered from base),
placed as materialized (select *, row_number() over () as k, row_number() over (partition by s order by doc_id nulls first, leaf) - 1 as i,
                               count(*) over (partition by s) as n from leaves),
a0 as (select s, n, i, leaf as d from placed),
ap0 as (select k, s, n, i as pos, '' as path, tampered as cur from placed),
{merkle_levels("a0", "ap0", "a", SOURCE_LEVELS)},
sub as materialized (select s, d, row_number() over (order by s) - 1 as i, count(*) over () as n from a{SOURCE_LEVELS}),
b0 as (select 0 as s, n, i, d from sub),
bp0 as (select k, 0 as s, sub.n, sub.i as pos, path, cur from ap{SOURCE_LEVELS} p join sub on sub.s = p.s),
{merkle_levels("b0", "bp0", "b", TOP_LEVELS)}
select doc_id, leaf, sub.d as subroot, r.d as root, sha256(p.path) as proof_sha256, p.cur as folded_root, p.cur = r.d as verified
from placed join bp{TOP_LEVELS} p using (k) join sub on sub.s = placed.s cross join b{TOP_LEVELS} r
"""
