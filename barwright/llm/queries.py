"""The thin queries over the operators of this folder, with production parameters and whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barwright.plans.shared import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents")).selectExpr("doc_id", "start", "length", "crc32(ids) as ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.topk import top_inner_products

    return top_inner_products(_table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), min_item_words=1)  # items of 1 to 4 words where they stand whole


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.token_files import read_token_files, write_token_files

    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(_table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) as ids_crc32")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.repeats import remove_repeats

    spans = "aggregate(removed, 0L, (n, s) -> n + s.end - s.start) as n_removed"
    return remove_repeats(_table(spark, sf_dir, "documents")).selectExpr("doc_id", "n_bytes", spans, "cast(size(removed) as long) as n_spans", "sha2(kept, 256) as kept_sha256")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.secrets import KINDS, find_secrets, joined

    counts = [f"cast(size(filter(base, s -> s.kind = {i})) as long) as n_{KINDS[i]}" for i in range(3)]
    return find_secrets(_table(spark, sf_dir, "documents")).selectExpr("doc_id", *counts, f"sha2({joined('base')}, 256) as base_sha256", f"{joined('spans')} as spans")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.language import identify_languages

    return identify_languages(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.sentence_pieces import decode_pieces, encode_pieces

    found = decode_pieces(encode_pieces(_table(spark, sf_dir, "documents")))
    return found.selectExpr("doc_id", "cast(size(ids) as long) as n_tokens", "sha2(array_join(ids, ','), 256) as ids_sha256", "sha2(decoded, 256) as decoded_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.lexical_search import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.merkle import build, prove, verify

    return verify(prove(build(_table(spark, sf_dir, "documents"))))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontaminate, op2_token_files, op3_repeats, op4_pack, op5_quality, op6_topk, op7_url_filter, op8_jaccard_join, op9_secrets, op10_language)
    return {f.__name__: f for f in (*own, op11_sentence_pieces, op12_lexical_search, op13_merkle_manifest)}


OP6_SQL = """
with p as (
    select cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as query_id, b.vec_id as vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
    from p a join p b on b.vec_id <> a.vec_id where a.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""


#: Decisions of pages and link targets, and components of equal nodes and links by the least node that is reached.
OP7_SQL = r"""
with recursive urls as (
    select url, html, page_id, coalesce(case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end, '') as rest from pages
), p as (
    select *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from urls
), found as (
    select url, host, path, unnest(list_concat(
        list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
        list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1))
    )) as target from p where url is not null
), linked as (
    select distinct url as source, case when contains(t, '://') then t when t like '//%' then scheme || ':' || t when t like '/%' then scheme || '://' || host || t
        else scheme || '://' || host || '/' || regexp_extract(path, '^/?(.*/)?[^/]*$', 1) || t end as target
    from (select *, replace(target, '&amp;', '&') as t, regexp_extract(url, '^([^:]*)://', 1) as scheme from found where target <> '')
), every_url as (select url as u from p where url is not null union select source from linked union select target from linked
), parts as (
    select u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
        array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(?:utm_[^=&]*|ref|fbclid|gclid)(?:=|$)')), '&') as kept
    from (select u, coalesce(case when position('://' in u) > 0 then substr(u, position('://' in u) + 3) end, '') as rest from every_url)
), rules(allow, rule_host, prefix) as (values (true, 'org', '/'), (false, 'example.org', '/es/'), (false, 'example.org', '/en/1'), (true, 'com', '/fr/'), (false, 'com', '/de/')
), best as (
    select u, arg_max(rule_host || prefix, 2 * length(rule_host || prefix) + allow::int) as rule, arg_max(allow, 2 * length(rule_host || prefix) + allow::int) as allow
    from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, prefix) group by u
), judged as (
    select parts.u, host, path, rule, allow, case when host <> '' then host || regexp_replace(path, '/+$', '') || case when kept <> '' then '?' || kept else '' end end as node
    from parts left join best using (u)
), edges as (
    select a.node as x, b.node as y from linked join judged a on a.u = source join judged b on b.u = target where a.node <> b.node
), both_ways as (select x, y from edges union select y, x from edges
), reach(node, label) as (select distinct x, x from both_ways union select b.y, r.label from reach r join both_ways b on b.x = r.node
), labels as (select node, min(label) as label from reach group by node
), said as (
    select coalesce(label, judged.node) as label, bool_or(allow) as allow from judged left join labels using (node) where judged.node is not null group by 1
)
select p.page_id, p.host, p.path, judged.rule as rule,
    case when coalesce(judged.allow, said.allow) then 'allow' when not coalesce(judged.allow, said.allow) then 'block' else 'allow' end as verdict
from p left join judged on judged.u = p.url left join labels using (node) left join said on said.label = coalesce(labels.label, judged.node)
"""

#: Shared shingles of all pairs, and the least document that links reach.
OP8_SQL = r"""
with recursive d as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
    select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from d
), one as (select min(doc_id) as doc_id, s from (select doc_id, list_sort(s) as s from s) where len(s) > 0 group by s
), e as (select doc_id, len(s) as n, unnest(s) as g from one
), links as (select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(x, label) as (select doc_id, doc_id from one union select l.y, r.label from reach r join links l on l.x = r.x
), labels as (select x, min(label) as label from reach group by x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(labels.label, s.doc_id) as component_id
from s left join one on one.s = list_sort(s.s) left join labels on labels.x = one.doc_id
"""

#: All 50-byte strings by their hexadecimal digits.
OP3_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from d)
), early as (select s, min(doc_id) as least from w group by s having min(doc_id) < max(doc_id)
), gone as (select w.doc_id, i from w join early using (s) where w.doc_id > least
), steps as (select *, lag(i) over (partition by doc_id order by i) as before from gone
), runs as (select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as run from steps
), spans as (select doc_id, run, min(i) as a, max(i) + 50 as b from runs group by doc_id, run
), cut as (
    select doc_id, list(struct_pack(a := a, b := b) order by a) as spans, sum(b - a) as n_removed, count(*) as n_spans from spans group by doc_id
)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
    sha256(unhex(case when spans is null then h else array_to_string(list_transform(range(0, len(spans) + 1),
        lambda j: substr(h, case when j = 0 then 1 else 2 * spans[j].b + 1 end, case when j = len(spans) then len(h) else 2 * spans[j + 1].a end - case when j = 0 then 0 else 2 * spans[j].b end)), '') end)) as kept_sha256
from d left join cut using (doc_id)
"""


#: Counts, integer impacts and sums of them; every document against every item by their terms in common.
OP12_SQL = r"""
with words as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null
), d as (select row_number() over () as r, doc_id, w, len(w) as n from words where len(w) > 0
), total as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from d
), i as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark
), tf as (select r, t, count(*) as tf from (select r, unnest(w) as t from d) where t in (select t from i) group by r, t
), df as (select t, count(*) as df from tf group by t
), w as (select t, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from df, total
), m as (select r, doc_id, 100 - 90 + (90 * n * docs) // terms as m from d, total
), s as (select item_id, r, any_value(doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score from i join tf using (t) join w using (t) join m using (r) group by item_id, r
), ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""


def _tree_sql(base: str, name: str, deep: int) -> str:
    """Common tables of a tree over ``base(grp, pos, n, h)``: its levels, and of every node the path to its group's root."""
    out = [f"{name}0 as (select grp, pos, n, h from {base})"]
    for k in range(deep):
        out.append(f"{name}{k + 1} as (select *, sha256(run) as h from (select grp, pos // 16 as pos, (max(n) + 15) // 16 as n, string_agg(h, '' order by pos) as run from {name}{k} where n > 1 group by 1, 2))")
    return ",\n".join(out)


def _path_sql(start: str, name: str, tree: str, deep: int) -> str:
    """From ``start(..., grp, pos, n, now, proof)`` upward: the last one has the root's digest as ``now``."""
    out = []
    for k in range(deep):
        source = start if not k else f"{name}{k}"
        left, right = "left(u.run, 64 * (s.pos % 16))", "substr(u.run, 64 * (s.pos % 16) + 65)"
        out.append(
            f"""{name}{k + 1} as (select s.* replace (case when u.run is null then s.pos else s.pos // 16 end as pos, (s.n + 15) // 16 as n, case when u.run is null then now else sha256({left} || now || {right}) end as now,
            case when u.run is null then proof else proof || {left} || {right} end as proof) from {source} s left join {tree}{k + 1} u on s.n > 1 and u.grp = s.grp and u.pos = s.pos // 16)"""
        )
    return ",\n".join(out)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", "text"))
#: The tree's levels and each leaf's path, six levels a source and four over the sources; crc32 by its table.
OP13_SQL = f"""
with bits as (select list(c order by k) as t from (select k, list_reduce(list_prepend(k, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(k))
), d as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 5 = 0 as hit from documents, bits
), leafs as (select doc_id, coalesce('=' || source, '') as grp, sha256({_LEAF}) as h, case when hit then sha256({_LEAF.replace("cast(text as varchar)", _LOWERED)}) end as changed from d
), base as (select *, row_number() over (partition by grp order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by grp) as n from leafs
), {_tree_sql("base", "s", 6)}
, tops as (select '' as grp, grp as member, row_number() over (order by encode(grp)) - 1 as pos, count(*) over () as n, h from ({" union all ".join(f"select grp, h from s{k} where n = 1" for k in range(7))}))
, {_tree_sql("tops", "r", 4)}
, start as (select doc_id, h as leaf, grp, pos, n, coalesce(changed, h) as now, '' as proof from base)
, {_path_sql("start", "p", "s", 6)}
, upper as (select p.doc_id, p.leaf, t.h as subroot, t.grp, t.pos, t.n, p.now, p.proof from p6 p join tops t on t.member = p.grp)
, {_path_sql("upper", "q", "r", 4)}
, top as (select h as root from ({" union all ".join(f"select h from r{k} where n = 1" for k in range(5))}))
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, now as folded_root, now = root as verified from q4, top
"""


def llm_oracle_sql() -> dict[str, str]:
    return {"op3_repeats": OP3_SQL, "op6_topk": OP6_SQL, "op7_url_filter": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op12_lexical_search": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
