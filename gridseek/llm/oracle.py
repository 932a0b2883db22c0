"""DuckDB SQL for the queries that SQL can say. The learned scores, the seeded shuffle, the keyed pseudonyms and the tokenizer are tested otherwise."""

from __future__ import annotations

from gridseek.llm.urlgraph import MARGIN, RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BREAK = "chr(10)"

LINES = rf"""with split as (select doc_id, string_split(text, {_BREAK}) as lines from documents where text is not null),
 l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from split),
 nb as (select *, row_number() over (partition by doc_id order by pos) as k, lead(line, 1) over (partition by doc_id order by pos) as l2, lead(line, 2) over (partition by doc_id order by pos) as l3 from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
 w as (select doc_id, k, row_number() over (partition by line, l2, l3 order by doc_id, k) as r from nb where l3 is not null),
 gone as (select distinct doc_id, k + d as k from w, (values (0), (1), (2)) t(d) where r > 1),
 marked as (select l.doc_id, l.pos, l.line, g.k is not null as out from l left join nb on l.doc_id = nb.doc_id and l.pos = nb.pos left join gone g on g.doc_id = nb.doc_id and g.k = nb.k),
 texts as (select doc_id, coalesce(string_agg(line, {_BREAK} order by pos) filter (where not out), '') as text, count(*) filter (where out) as n_removed from marked group by 1),
 counts as (select doc_id, count(*) as n_lines from nb group by 1)
 select d.doc_id, case when d.text is null then null else t.text end as text, coalesce(c.n_lines, 0) as n_lines, coalesce(t.n_removed, 0) as n_removed
 from documents d left join texts t using (doc_id) left join counts c using (doc_id)"""

_WORDS = r"regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = rf"""with items as (select item_id, {_WORDS} as w from benchmark where text is not null),
 sized as (select item_id, w, least(10, len(w)) as n from items where len(w) > 0),
 windows as (select distinct item_id, n, array_to_string(w[p:p+n-1], ' ') as win from (select item_id, w, n, unnest(range(1, len(w)-n+2)) as p from sized)),
 docs as (select doc_id, {_WORDS} as w from documents where text is not null),
 places as (select doc_id, n, p, array_to_string(w[p:p+n-1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w)-n+2)) as p from docs, (select distinct n from windows) s where len(w) >= n)),
 met as (select doc_id, p, places.n, item_id from places join windows on places.n = windows.n and places.win = windows.win),
 hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p+n)) as q from met) group by 1),
 found as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from met) group by 1)
 select d.doc_id, coalesce(len(c.w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
 from documents d left join docs c using (doc_id) left join hit using (doc_id) left join found using (doc_id)"""

NEAR = rf"""with recursive docs as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') as w from documents where text is not null),
 s as materialized (select distinct doc_id, array_to_string(w[p:p+4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(1, len(w)-4)+1)) as p from docs where len(w) > 0)),
 n as materialized (select doc_id, count(*) as n from s group by 1),
 shared as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 links as materialized (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100*m >= 85*(x.n+y.n-m)),
 sides as (select a, b from links union all select b, a from links),
 reach as (select doc_id as a, doc_id as b from n union select r.a, e.b from reach r join sides e on e.a = r.b)
 select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, coalesce(c.component_id, d.doc_id) = d.doc_id as kept
 from documents d left join n using (doc_id) left join (select a as doc_id, min(b) as component_id from reach group by 1) c using (doc_id)"""

REPEATS = """with bytes_ as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 w as (select doc_id, p, md5_number(substring(h, 2*p-1, 200)) as k from (select doc_id, h, unnest(range(1, len(h)//2-98)) as p from bytes_ where len(h) >= 200)),
 later as materialized (select doc_id, p from (select doc_id, p, row_number() over (partition by k order by doc_id, p) as r from w) where r > 1),
 marked as (select *, case when p > lag(p) over (partition by doc_id order by p) + 100 then 1 else 0 end as new from later),
 spans as (select doc_id, run, min(p) as low, max(p)+100 as high from (select *, sum(new) over (partition by doc_id order by p) as run from marked) group by 1, 2),
 pieces as (select doc_id, coalesce(lag(high) over (partition by doc_id order by low), 1) as a, low as b from spans union all select doc_id, max(high), 1000000000 from spans group by 1),
 kept as (select doc_id, string_agg(substring(h, 2*a-1, 2*(b-a)), '' order by a) as h from pieces join bytes_ using (doc_id) group by 1),
 counts as (select doc_id, sum(high-low) as removed, count(*) as n from spans group by 1)
 select d.doc_id, len(d.h)//2 as n_bytes, cast(coalesce(c.removed, 0) as bigint) as n_removed, coalesce(c.n, 0) as n_spans, sha256(unhex(coalesce(k.h, d.h))) as kept_sha256
 from bytes_ d left join kept k using (doc_id) left join counts c using (doc_id)"""

TOP = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256e0*cast(x as double))) as e from embeddings where embedding is not null and vec_id is not null and len(embedding) > 0
 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 p as (select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) as score from v q join v on q.vec_id % 50 = 0 and q.vec_id != v.vec_id and len(q.e) = len(v.e))
 select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5"""


def _judged(rounds: int = 10, damping: float = 0.85) -> str:
    """The rules, and the ranks unrolled round by round."""
    host = _LOWER.format(r"regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1)")
    rules = sorted(sorted(RULES, key=lambda r: r[1] + r[2]), key=lambda r: -len(r[1] + r[2]))
    fits = [(k, h + p, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')") for k, h, p in rules]
    cases = lambda i: "case " + " ".join(f"when {f[2]} then '{f[i]}'" for f in fits) + " end"
    parts = [
        rf"with parsed as (select page_id, html, coalesce({host.format('url')}, '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages)",
        f"own as materialized (select *, {cases(1)} as rule, {cases(0)} as ruled from parsed)",
        r"""links as (select host as a, unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)', 1)) as link from own where html is not null)""",
        f"edges as materialized (select a, b, count(*) as n from (select a, {host.format("case when starts_with(link, '//') then 'x:' || link else link end")} as b from links) where a != b and a != '' and b != '' group by 1, 2)",
    ]
    for kind, a, b in (("allow", "a", "b"), ("block", "b", "a")):
        parts.append(f"{kind}_share as materialized (select {a} as a, {b} as b, cast(n as double)/sum(n) over (partition by {a}) as share from edges)")
        parts.append(f"{kind}_seed as materialized (select host, cast(count(*) as double)/sum(count(*)) over () as weight from own where ruled = '{kind}' group by 1)")
        parts.append(f"{kind}0 as materialized (select host, weight as rank from {kind}_seed)")
        for i in range(1, rounds + 1):
            parts.append(f"{kind}_sent{i} as materialized (select b as host, sum(rank*share)*{damping}e0 as rank from {kind}_share join {kind}{i - 1} r on r.host = a group by 1)")
            parts.append(f"{kind}{i} as materialized (select host, sum(rank) as rank from (select * from {kind}_sent{i} union all select host, weight*(1-(select coalesce(sum(rank), 0) from {kind}_sent{i})) from {kind}_seed) group by 1)")
    bad = f"select host from block{rounds} b left join allow{rounds} t using (host) where b.rank > coalesce(t.rank, 0)*{MARGIN}e0"
    return ", ".join(parts) + f" select page_id, host, path, rule, coalesce(ruled, case when host in ({bad}) then 'block' else 'allow' end) as verdict from own"


SQL: dict[str, str] = {
    "op3_line_dedup": LINES,
    "op4_decontamination": CONTAMINATION,
    "op6_url_graph": _judged(),
    "op7_suffix_dedup": REPEATS,
    "op9_near_duplicates": NEAR,
    "op10_top_k": TOP,
}
