"""All queries of the core, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions import cleanup, text
from sheafline.operators import attest, claims, concepts, dedupe, graph, incremental, quality, reports, search, vectors
from sheafline.operators.concepts import ORDER_CONCEPTS_SQL
from sheafline.plans import minisql
from sheafline.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NOW = "2025-06-01"


def add(name: str, f: Query, sql: str | None = None) -> None:
    _QUERIES[name] = f
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(name: str) -> Query:
    return lambda s, d: table(s, d, name)


def on(f: Callable[..., DataFrame], *names: str) -> Query:
    return lambda s, d: f(*[table(s, d, n) for n in names])


# ---- SQL pieces --------------------------------------------------------------------------------------------------

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQUEEZED = f"trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))"
WORDS = f"list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> '')"
DELIVERED = "delivered as (select * from chunks qualify row_number() over (partition by id order by indexed_at desc, ordinal desc) = 1)"
TERMS = f"list_filter(string_split_regex(translate(lower(text), '{text.MARKED}', '{text.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
CONCEPT = "regexp_replace(source_relpath, '\\.[^./]+$', '.md')"
LATEST = f"latest as (select *, {CONCEPT} as concept_id from canonical_docs where source_relpath is not null qualify row_number() over (partition by {CONCEPT} order by converted_at desc, canon_id desc) = 1)"
RUNS = "runs as (select * from run_results qualify row_number() over (partition by result_id, run_no, relpath order by recorded_at) = 1)"


def _bm25_sql(words: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(ts, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(words)))
    idf = lambda i: f"(case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 then 1e-6 else ln((n - df{i} + 0.5) / (df{i} + 0.5)) end)"
    score = " + ".join(f"{idf(i)} * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(words)))
    cond = " and ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"with {DELIVERED}, toks as (select id, {TERMS} as ts from delivered where text is not null), l as (select id, len(ts) as dl, {tf} from toks), s as (select count(*) as n, avg(dl) as avgdl, {df} from l) select id, round(-({score}), 6) as score from l, s where {cond}"


def _match_sql(cond: str) -> str:
    return f"with {DELIVERED}, toks as (select id, {TERMS} as ts from delivered where text is not null) select id from toks where {cond}"


def _top_sql(hits: list[str], cond: str, limit: int = 20) -> str:
    """The best chunks by BM25; ``hits`` count a word or phrase in ts, ``cond`` says over tf0, tf1, ... which chunks match."""
    tf = ", ".join(f"{h} as tf{i}" for i, h in enumerate(hits))
    df = ", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(hits)))
    idf = lambda i: f"(case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 then 1e-6 else ln((n - df{i} + 0.5) / (df{i} + 0.5)) end)"
    score = " + ".join(f"{idf(i)} * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(hits)))
    return f"with {DELIVERED}, toks as (select id, concept_id, ordinal, {TERMS} as ts from delivered where text is not null and concept_id is not null), l as (select id, concept_id, ordinal, len(ts) as dl, {tf} from toks), s as (select count(*) as n, avg(dl) as avgdl, {df} from l), r as (select id, -({score}) as score, concept_id, ordinal from l, s where {cond}) select id, round(score, 6) as score, concept_id, ordinal from r order by r.score, concept_id, ordinal limit {limit}"


def _word_hits(word: str) -> str:
    return f"len(list_filter(ts, lambda x: x = '{word}'))"


def _phrase_hits(words: list[str]) -> str:
    return f"len(list_filter(range(1, len(ts) + 1), lambda i: ts[i:i + {len(words) - 1}] = [{', '.join(repr(w) for w in words)}]))"


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return concepts.delivered(table(s, d, "chunks"))


def _orders(s: SparkSession, d: str) -> DataFrame:
    return concepts.order_concepts(spread(table(s, d, "orders")), table(s, d, "lineitem"), table(s, d, "customer"))


# ---- text functions ----------------------------------------------------------------------------------------------

add("fn01_words", on(lambda t: spread(t).where("text is not null").select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("n_words"), text.token_estimate(F.col("text")).cast("bigint").alias("token_estimate"), F.sha2(text.squeeze(F.col("text")), 256).alias("squeezed_sha")), "documents"),
    f"select doc_id, len({WORDS}) as n_words, greatest(1, (len({WORDS}) + 3) // 4) as token_estimate, sha256({SQUEEZED}) as squeezed_sha from documents where text is not null")
add("fn06_description", on(lambda t: t.where("body_md is not null").select("canon_id", text.description(F.col("body_md")).alias("description")), "canonical_docs"),
    "with f as (select canon_id, list_filter(list_transform(string_split(body_md, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not regexp_matches(x, '^(#|```|>)'))[1] as d from canonical_docs where body_md is not null) select canon_id, case when length(d) > 120 then substr(d, 1, 117) || '...' else d end as description from f")
add("fn07_path_tags", on(lambda t: t.where("source_relpath is not null").select("canon_id", F.array_join(text.path_tags(F.col("source_relpath")), ",").alias("tags")), "canonical_docs"),
    "with p as (select canon_id, list_filter(string_split(lower(regexp_extract(source_relpath, '^(.*)/[^/]*$', 1)), '/'), lambda x: x <> '') || list_filter([lower(regexp_extract(source_relpath, '\\.([^./]+)$', 1))], lambda x: x <> '') as t from canonical_docs where source_relpath is not null), u as (select canon_id, unnest(t) as tag, generate_subscripts(t, 1) as i from p), g as (select canon_id, tag, min(i) as i from u group by all) select p.canon_id, coalesce(string_agg(tag, ',' order by g.i), 'document') as tags from p left join g using (canon_id) group by p.canon_id")
add("fn10_slug", on(lambda t: t.where("title is not null").select("canon_id", text.slug(F.col("title")).alias("slug")), "canonical_docs"),
    "select canon_id, substr(regexp_replace(regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g'), '^[_.-]+|[_.-]+$', '', 'g'), 1, 80) as slug from canonical_docs where title is not null")
add("fn17_entities", on(lambda t: t.where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", "[^\\x00-\\x7F]", "_"), F.lit(text.ENTITY), F.lit(0)))).alias("entity")), "documents"),
    "with e as (select doc_id, regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b') as x from documents where text is not null) select distinct doc_id, unnest(x) as entity from e")
add("fn22_trust_badge", on(lambda t: t.select("canon_id", quality.trust_badge(F.col("okf_verified"), F.col("okf_status"), F.col("okf_stale_after"), NOW).alias("badge")), "canonical_docs"),
    f"select canon_id, case when okf_status = 'deprecated' then 'deprecated' when okf_stale_after <= '{NOW}' then 'stale' when okf_verified like 'human:%' and okf_verified <> 'human:pending' then 'human-reviewed' when okf_verified like 'process:%' then 'machine-confirmed' else 'unverified' end as badge from canonical_docs")
add("fn27_glob", on(lambda t: t.where(F.regexp_extract("source_relpath", "([^/]+)$", 1).rlike(text.glob_regex("*-0000000[0-9]?.pdf"))).select("canon_id", "source_relpath"), "canonical_docs"),
    "select canon_id, source_relpath from canonical_docs where regexp_matches(regexp_extract(source_relpath, '([^/]+)$', 1), '^.*-0000000[0-9].\\.pdf$')")

# ---- cleanup stages ----------------------------------------------------------------------------------------------


def _stage(name: str) -> Query:
    return on(lambda t: spread(t).where("body_md is not null").select("canon_id", F.sha2(cleanup.STAGES[name](F.col("body_md")), 256).alias("sha")), "canonical_docs")


def _nested(table_: dict[str, str], inner: str) -> str:
    for a, b in table_.items():
        inner = f"replace({inner}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return inner


for _no, _name, _expr in (
    ("01", "compose", "replace(replace(nfc_normalize(body_md), chr(13) || chr(10), chr(10)), chr(13), chr(10))"),
    ("02", "soft_hyphens", "replace(body_md, chr(173), '')"),
    ("03", "ligatures", _nested(text.LIGATURES, "body_md")),
    ("04", "quotes", _nested(text.QUOTES, "body_md")),
    ("05", "spaces", "regexp_replace(regexp_replace(body_md, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"),
    ("06", "entities", None),
    ("07", "wraps", None),
    ("08", "hyphens", "regexp_replace(body_md, '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g')"),
    ("09", "contents", None),
    ("10", "bylines", "array_to_string(list_transform(string_split(body_md, chr(10)), lambda x: case when len(list_filter(string_split(body_md, chr(10)), lambda y: y = trim(x) and length(y) between 8 and 120)) >= 2 then '' else x end), chr(10))"),
    ("11", "orphans", "regexp_replace(body_md, '(?m)^[ \\t]*[|>+\\-=*#~]{1,3}[ \\t]*$', '', 'g')"),
    ("12", "headings", None),
):
    add(f"t{_no}_{_name}", _stage(_name), f"select canon_id, sha256({_expr}) as sha from canonical_docs where body_md is not null" if _expr else None)
add("t_clean_all", on(lambda t: spread(t).where("body_md is not null").select("canon_id", F.sha2(cleanup.clean(F.col("body_md")), 256).alias("sha")), "canonical_docs"))

# ---- blocks and chunks -------------------------------------------------------------------------------------------

add("c01_blocks", on(lambda t: concepts.blocks(spread(t).where("body_md is not null"), "body_md", "canon_id").groupBy("canon_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), "canonical_docs"),
    "with b as (select canon_id, unnest(list_filter(string_split_regex(regexp_replace(body_md, '^\\s+|\\s+$', '', 'g'), '\\n\\s*\\n'), lambda x: not regexp_matches(x, '^\\s*$'))) as raw from canonical_docs where body_md is not null), k as (select canon_id, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as t from b) select canon_id, case when regexp_matches(t, '^#{1,6}\\s+[^\\n]+$') then 'heading' when ltrim(raw) like '|%' then 'table' else 'paragraph' end as kind, count(*) as n, cast(sum(length(t)) as bigint) as chars from k group by all")
add("c02_chunk_pack", on(lambda t: concepts.chunks_of(spread(t).where("body_md is not null"), "body_md", "canon_id").select("canon_id", "ordinal", "heading", "token_estimate", "oversize", "chunk_id"), "canonical_docs"))
add("c04_citation", on(concepts.citations, "chunks"),
    f"with {DELIVERED} select source_sha256, min(citation.page) as first_page, min(citation.start_char) as start_char, max(citation.end_char) as end_char, count(*) as n_chunks from delivered group by source_sha256")
add("c05_missing_citation", on(lambda c: c.where("citation is null or citation.source_sha256 is null or citation.source_uri is null").select("id"), "chunks"), "select id from chunks where citation is null or citation.source_sha256 is null or citation.source_uri is null")

# ---- index and search --------------------------------------------------------------------------------------------

add("x03_term_df", lambda s, d: search.term_counts(_chunks(s, d)),
    f"with {DELIVERED}, t as (select id, unnest({TERMS}) as term from delivered), p as (select term, id, count(*) as tf from t group by all) select term, count(*) as df, cast(sum(tf) as bigint) as cf from p group by term")
add("x01_postings", lambda s, d: search.postings(_chunks(s, d)).groupBy("id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf")),
    f"with {DELIVERED}, t as (select id, unnest({TERMS}) as term from delivered), p as (select term, id, count(*) as tf from t group by all) select id, count(*) as n_terms, cast(sum(tf) as bigint) as n_tokens, max(tf) as max_tf from p group by id")
for _name, _words in (("single", ["ledger"]), ("multi", ["scanned", "ledger", "cabinet"])):
    add(f"x05_bm25_{_name}", lambda s, d, w=_words: search.bm25(_chunks(s, d), w).select("id", F.round("score", 6).alias("score")), _bm25_sql(_words))
add("x09_top20", lambda s, d: search.search(_chunks(s, d).where("concept_id is not null"), "ledger cabinet", 20).select("id", F.round("score", 6).alias("score"), "concept_id", "ordinal"))
for _name, _query, _hits, _cond in (
    ("or", "Feuchtigkeit OR humidity OR cabinet", [_word_hits("feuchtigkeit"), _word_hits("humidity"), _word_hits("cabinet")], "tf0 > 0 or tf1 > 0 or tf2 > 0"),
    ("phrase", '"scanned ledger"', [_phrase_hits(["scanned", "ledger"])], "tf0 > 0"),
    ("nested", "ledger (cabinet OR archive)", [_word_hits("ledger"), _word_hits("cabinet"), _word_hits("archive")], "tf0 > 0 and (tf1 > 0 or tf2 > 0)"),
):
    add(f"x09_{_name}20", lambda s, d, q=_query: search.search(_chunks(s, d).where("concept_id is not null"), q, 20).select("id", F.round("score", 6).alias("score"), "concept_id", "ordinal"), _top_sql(_hits, _cond))
for _name, _query, _cond in (
    ("and", "ledger AND cabinet", "list_contains(ts, 'ledger') and list_contains(ts, 'cabinet')"),
    ("or", "Feuchtigkeit OR humidity", "list_contains(ts, 'feuchtigkeit') or list_contains(ts, 'humidity')"),
    ("not", "ledger NOT scanned", "list_contains(ts, 'ledger') and not list_contains(ts, 'scanned')"),
    ("phrase", '"scanned ledger"', "(' ' || array_to_string(ts, ' ') || ' ') like '% scanned ledger %'"),
    ("prefix", "conver*", "len(list_filter(ts, lambda x: starts_with(x, 'conver'))) > 0"),
    ("first", "^the", "ts[1] = 'the'"),
    ("nested", "(humidity OR basement) AND NOT moved", None),
    ("near", "NEAR(archive folders, 6)", "len(list_filter(range(1, len(ts) + 1), lambda i: ts[i] in ('archive', 'folders') and list_contains(ts[i:i + 7], 'archive') and list_contains(ts[i:i + 7], 'folders'))) > 0"),
):
    if _name == "nested":
        _query, _cond = "(humidity OR basement) NOT moved", "(list_contains(ts, 'humidity') or list_contains(ts, 'basement')) and not list_contains(ts, 'moved')"
    add(f"x04_{_name}", lambda s, d, q=_query: search.match(_chunks(s, d).where("text is not null"), q).select("id"), _match_sql(_cond))


def _with_concept(s: SparkSession, d: str) -> DataFrame:
    c = concepts.canonical_concepts(table(s, d, "canonical_docs")).select("concept_id", "okf_type", "okf_status", "bundle")
    return _chunks(s, d).join(c, "concept_id")


add("x06_filters", lambda s, d: search.match(_with_concept(s, d).where("okf_type = 'Document' and okf_status = 'unverified'").where(F.col("concept_id").ilike("files/%")), "cabinet").select("id"),
    f"with {DELIVERED}, {LATEST}, toks as (select id, concept_id, {TERMS} as ts from delivered where text is not null) select id from toks join latest using (concept_id) where okf_type = 'Document' and okf_status = 'unverified' and concept_id ilike 'files/%' and list_contains(ts, 'cabinet')")
add("x06_tag_semi", lambda s, d: _chunks(s, d).join(concepts.canonical_concepts(table(s, d, "canonical_docs")).where(F.array_contains(text.path_tags(F.col("source_relpath")), "pdf")).select("concept_id"), "concept_id", "left_semi").select("id"),
    f"with {DELIVERED}, {LATEST} select id from delivered where exists (select 1 from latest where latest.concept_id = delivered.concept_id and lower(source_relpath) like '%.pdf')")
add("x07_missing_concepts", lambda s, d: _chunks(s, d).join(concepts.canonical_concepts(table(s, d, "canonical_docs")).select("concept_id"), "concept_id", "left_anti").select("id"),
    f"with {DELIVERED}, {LATEST} select id from delivered where not exists (select 1 from latest where latest.concept_id = delivered.concept_id)")
add("x10_substring", on(lambda t: search.substring_hits(t, "Ledger", ("title", "body_md")).select("canon_id"), "canonical_docs"),
    "select canon_id from canonical_docs where contains(lower(title), 'ledger') or contains(lower(body_md), 'ledger')")
add("x12_page", on(lambda t: concepts.canonical_concepts(t).select("concept_id").orderBy("concept_id").offset(50).limit(50), "canonical_docs"),
    f"with {LATEST} select concept_id from latest order by concept_id limit 50 offset 50")


def _delta(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").select("id", "indexed_at", F.sha2(F.concat_ws("\x00", "id", F.col("indexed_at").cast("date").cast("string")), 256).alias("hash"))
    old = c.where("indexed_at < timestamp'2025-01-01'").groupBy("id").agg(F.max("hash").alias("hash"))
    new = c.where("indexed_at >= timestamp'2024-07-01'").groupBy("id").agg(F.max("hash").alias("hash"))
    return search.index_delta(old, new).groupBy("action").agg(F.count("*").alias("n"))


add("x02_index_delta", _delta,
    "with c as (select id, indexed_at, sha256(id || chr(0) || cast(cast(indexed_at as date) as varchar)) as h from chunks), o as (select id, max(h) as h from c where indexed_at < timestamp '2025-01-01' group by id), n as (select id, max(h) as h from c where indexed_at >= timestamp '2024-07-01' group by id) select case when o.h is null then 'added' when n.h is null then 'removed' when o.h <> n.h then 'changed' else 'kept' end as action, count(*) as n from o full join n using (id) group by 1")

# ---- graph -------------------------------------------------------------------------------------------------------


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.build_edges(_chunks(s, d), concepts.canonical_concepts(table(s, d, "canonical_docs")).select("concept_id"))


_EDGES_SQL = f"""{DELIVERED}, edges as (
  select 'contains' as kind, 'concept:' || concept_id as from_id, 'chunk:' || id as to_id from delivered
  union all select 'cites', 'chunk:' || id, 'source:' || source_sha256 from delivered where source_sha256 is not null
  union all select 'mentions', 'chunk:' || id, 'topic:' || sha256('topic' || chr(0) || lower(trim(regexp_replace(label, '{SPACE}+', ' ', 'g')))) from (select id, unnest(heading_path) as label from delivered))"""
add("r01_edges", lambda s, d: _edges(s, d).where("method in ('canonical_chunks/v1', 'heading_topic/v1')").select("kind", "from_id", "to_id"), f"with {_EDGES_SQL} select * from edges")
add("r01_entities", lambda s, d: _edges(s, d).where("method = 'capitalized_entity/v1'").groupBy("to_id").agg(F.count("*").alias("n")))
add("r01_nodes", lambda s, d: graph.build_nodes(_edges(s, d).where("method in ('canonical_chunks/v1', 'heading_topic/v1')")),
    f"with {_EDGES_SQL}, ends as (select from_id as id, 1 as o, 0 as i from edges union all select to_id, 0, 1 from edges) select id, split_part(id, ':', 1) as kind, cast(sum(o) as bigint) as degree_out, cast(sum(i) as bigint) as degree_in from ends group by id")
add("r03_kind_filter", lambda s, d: _edges(s, d).where(~F.col("kind").isin("mentions", "related_to")).groupBy("kind").agg(F.count("*").alias("n")), f"with {_EDGES_SQL} select kind, count(*) as n from edges where kind not in ('mentions', 'related_to') group by kind")


def _parts(s: SparkSession, d: str) -> DataFrame:
    """Links of the relational tables: order -> customer -> nation -> region."""
    o = table(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("from_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("to_id"))
    c = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("from_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("to_id"))
    n = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("from_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("to_id"))
    return o.unionByName(c).unionByName(n)


_PARTS_SQL = "e as (select 'o' || o_orderkey as f, 'c' || o_custkey as t from orders union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"
add("r04_bfs2", lambda s, d: graph.reachable(_parts(s, d), s.createDataFrame([("o1",), ("o7",)], "id string"), 2),
    f"with recursive {_PARTS_SQL}, w as (select unnest(['o1', 'o7']) as id, 0 as level union all select distinct e.t, w.level + 1 from w join e on e.f = w.id where w.level < 2) select id, min(level) as level from w group by id")
add("r07_context", lambda s, d: graph.reachable(_parts(s, d), s.createDataFrame([("n3",)], "id string"), 1, both_ways=True).groupBy("level").agg(F.count("*").alias("n")),
    f"with {_PARTS_SQL}, u as (select f as a, t as b from e union select t, f from e) select level, count(*) as n from (select 'n3' as id, 0 as level union select b, 1 from u where a = 'n3') group by level")
add("r08_related", lambda s, d: graph.related(_parts(s, d), "n3", 10),
    f"with {_PARTS_SQL} select id, count(*) as score from (select t as id from e where f = 'n3' union all select f from e where t = 'n3') group by id order by score desc, id limit 10")
add("r09_impact", lambda s, d: graph.impact(_parts(s, d), table(s, d, "orders").where("o_orderkey % 20 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id")), returning=True),
    f"with recursive {_PARTS_SQL}, w as (select 'o' || o_orderkey as id, 0 as level from orders where o_orderkey % 20 = 0 union select e.t, w.level + 1 from w join e on e.f = w.id) select id, min(level) as level from w where level > 0 group by id")
add("r09_impact_evidence", lambda s, d: graph.impact(_edges(s, d), _edges(s, d).where("kind = 'contains' and method = 'canonical_chunks/v1'").where(F.crc32(F.col("from_id").cast("binary")) % 20 == 0).select(F.col("from_id").alias("id")), returning=True))
_LINKS_SQL = f"{LATEST}, l as (select concept_id as source, unnest(regexp_extract_all(body_md, '\\[[^\\]]+\\]\\(([^)]+)\\)', 1)) as raw from latest), p as (select source, trim(split_part(raw, '#', 1)) as t from l), q as (select distinct source, case when t like '/%' then ltrim(t, '/') else regexp_extract(source, '^(.*)/[^/]*$', 1) || '/' || t end as target from p where t <> '' and not contains(t, '://'))"


def _doc_links(s: SparkSession, d: str) -> DataFrame:
    return graph.concept_links(concepts.canonical_concepts(table(s, d, "canonical_docs")), "body_md")


add("r06_unresolved", lambda s, d: _doc_links(s, d).where("not exists").groupBy("source").agg(F.count("*").alias("n")),
    f"with {_LINKS_SQL} select source, count(*) as n from q where source <> target and target not in (select concept_id from latest) group by source")
add("r05_order_links", lambda s, d: graph.concept_links(_orders(s, d)).select("source", "target"),
    f"with {ORDER_CONCEPTS_SQL} select concept_id as source, 'customers/' || regexp_extract(body, 'customers/([0-9]+)\\.md', 1) || '.md' as target from order_concepts")
add("r10_linkify", lambda s, d: graph.linkify(concepts.canonical_concepts(table(s, d, "canonical_docs")).where("title is not null and body_md is not null"), "body_md").select("concept_id", F.size("mentions").cast("bigint").alias("n_mentions"), "body_md"))
add("r11_resolve", lambda s, d: concepts.canonical_concepts(table(s, d, "canonical_docs")).where(F.lower("title").contains("ledger") | F.col("concept_id").endswith("000000012.md")).select("concept_id"),
    f"with {LATEST} select concept_id from latest where contains(lower(title), 'ledger') or concept_id like '%000000012.md'")

# ---- duplicates and differences ----------------------------------------------------------------------------------

add("d01_exact_families", on(lambda t: dedupe.exact_families(t.where("text is not null"), "doc_id", F.sha2("text", 256)), "documents"),
    "select sha256('exact' || chr(0) || sha256(text)) as family_id, count(*) as n_members, min(doc_id) as first_member from documents where text is not null group by text having count(*) > 1")
add("d01_membership", on(lambda t: dedupe.membership(t.where("source_sha256 is not null"), "canon_id", F.col("source_sha256")), "canonical_docs"),
    "select canon_id, source_sha256 as digest, count(*) over (partition by source_sha256) as n_members from canonical_docs where source_sha256 is not null")
add("d02_near_duplicates", on(lambda t: dedupe.near_duplicates(t, "doc_id", "text"), "documents"))
add("d04_bundle_texts", lambda s, d: _chunks(s, d).groupBy("concept_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text"))), lambda x: x["text"]), "\n"), 256).alias("sha")),
    f"with {DELIVERED} select concept_id, sha256(string_agg(text, chr(10) order by ordinal, id)) as sha from delivered where text is not null group by concept_id")


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "canonical_docs").where("source_relpath is not null")
    at = lambda cond: docs.where(cond).groupBy("source_relpath").agg(F.max_by("source_sha256", F.struct("converted_at", "canon_id")).alias("digest"))
    return incremental.snapshot_diff(at("converted_at < timestamp'2025-01-01'"), at("converted_at >= timestamp'2024-09-01'"), "source_relpath", "digest")


add("d10_snapshot_diff", _snapshots,
    "with o as (select source_relpath, arg_max(source_sha256, (converted_at, canon_id)) as g from canonical_docs where source_relpath is not null and converted_at < timestamp '2025-01-01' group by 1), n as (select source_relpath, arg_max(source_sha256, (converted_at, canon_id)) as g from canonical_docs where source_relpath is not null and converted_at >= timestamp '2024-09-01' group by 1) select source_relpath, case when o.g is null then 'added' when n.g is null then 'removed' else 'changed' end as change from o full join n using (source_relpath) where o.g is distinct from n.g")

# ---- claims ------------------------------------------------------------------------------------------------------


def _order_claims(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d)
    return claims.claims(o, "concept_id", "body", F.concat(F.lit("g"), (F.col("order_key") % 97).cast("string")))


_CLAIMS_SQL = f"""{ORDER_CONCEPTS_SQL}, found as (
  select concept_id as chunk, 'g' || (order_key % 97) as scope, 'owner' as kind, regexp_extract_all(body, '(?im)^owner:\\s*(.+)$', 1) as v from order_concepts
  union all select concept_id, 'g' || (order_key % 97), 'amount', regexp_extract_all(body, '\\$([0-9][0-9,]*(?:\\.[0-9]{{2}})?)\\b', 1) from order_concepts
  union all select concept_id, 'g' || (order_key % 97), 'status_label', regexp_extract_all(body, '(?im)^status:\\s*(.+)$', 1) from order_concepts
  union all select concept_id, 'g' || (order_key % 97), 'date', regexp_extract_all(body, '\\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\\b', 1) from order_concepts),
  claims as (select chunk, scope, kind, lower(trim(unnest(v))) as value from found)"""
add("m01_claims", lambda s, d: _order_claims(s, d).select("claim_id", "kind", "value", "chunk"), f"with {_CLAIMS_SQL} select sha256(kind || chr(0) || value || chr(0) || chunk) as claim_id, kind, value, chunk from claims")
add("m02_cap", lambda s, d: claims.capped(_order_claims(s, d)), f"with {_CLAIMS_SQL} select count(*) as total, least(count(*), 5000) as kept, count(*) > 5000 as too_many from claims")
add("m03_suppressed", lambda s, d: claims.suppressed(_order_claims(s, d), ("amount",)).groupBy("kind", "status").agg(F.count("*").alias("n")), f"with {_CLAIMS_SQL} select kind, case when kind = 'amount' then 'suppressed' else 'unverified' end as status, count(*) as n from claims group by all")
add("m04_conflicts", lambda s, d: claims.conflicts(_order_claims(s, d)),
    f"with {_CLAIMS_SQL}, g as (select scope, kind, value, count(*) as n from claims group by all) select scope, kind, count(*) as n_values, cast(sum(n) as bigint) as n_claims, cast((sum(n) * sum(n) - sum(n * n)) // 2 as bigint) as n_conflicts from g group by scope, kind having count(*) > 1")
add("m05_stale", on(lambda t: claims.stale_sources(t, NOW), "canonical_docs"), f"select distinct source_sha256, okf_stale_after as stale_after, sha256('stale' || chr(0) || source_sha256 || okf_stale_after) as finding_id from canonical_docs where okf_stale_after < '{NOW}'")

# ---- quality -----------------------------------------------------------------------------------------------------

_LINT_SQL = "lint as (select canon_id, severity, rule from (select canon_id, unnest([case when okf_type is null or trim(okf_type) = '' then 'error type-required' end, case when length(okf_type) > 60 then 'warning type-length' end, case when source_uri is null or trim(source_uri) = '' then 'error sources-uri' end, case when not coalesce(regexp_full_match(source_sha256, '[0-9a-f]{64}'), false) then 'error sources-sha256' end, case when okf_status is null or trim(okf_status) = '' then 'warning status-missing' end, case when okf_verified is null or trim(okf_verified) = '' then 'warning verified-missing' end, case when body_md is null or trim(body_md) = '' then 'warning body-empty' end]) as f, split_part(f, ' ', 1) as severity, split_part(f, ' ', 2) as rule from canonical_docs) where f is not null)"
add("q01_concept_lint", on(quality.concept_lint, "canonical_docs"), f"with {_LINT_SQL} select * from lint")
add("q03_severity_counts", on(lambda t: quality.severities(quality.concept_lint(t)), "canonical_docs"), f"with {_LINT_SQL} select count(*) filter (where severity = 'error') as error, count(*) filter (where severity = 'warning') as warning, count(*) filter (where severity = 'info') as info from lint")
_LINES_SQL = "lines as (select canon_id, l as line, generate_subscripts as line_no from (select canon_id, unnest(string_split(body_md, chr(10))) as l, generate_subscripts(string_split(body_md, chr(10)), 1) - 1 as generate_subscripts from canonical_docs where body_md is not null))"
add("q02_markdown_lint", on(lambda t: quality.markdown_lint(t.where("body_md is not null")).select("canon_id", F.col("line_no").cast("bigint").alias("line_no"), "rule"), "canonical_docs"),
    f"with {_LINES_SQL}, h as (select canon_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) as lv from lines), k as (select *, lag(lv) over (partition by canon_id order by line_no) as b from h where lv > 0) select canon_id, line_no, 'heading-skip' as rule from k where lv > b + 1 union all select canon_id, -1, 'fence-odd' from lines where line like '```%' group by canon_id having count(*) % 2 = 1 union all select canon_id, line_no, 'line-length' from lines where length(line) > 200")
add("q05_policy", on(lambda t: quality.policy(t, ("Document", "Record"), ("*",), ("human:reviewed",)), "canonical_docs"),
    "select canon_id, rule from (select canon_id, unnest([case when coalesce(okf_type, '') not in ('Document', 'Record') then 'type' end, case when coalesce(okf_status, '') = '' then 'status' end, case when coalesce(okf_verified, '') not in ('human:reviewed') then 'verified' end, case when source_uri is null then 'sources' end, case when not coalesce(regexp_full_match(source_sha256, '[0-9a-f]{64}'), false) then 'sha256' end]) as rule from canonical_docs) where rule is not null")
for _pack in ("research", "legal-hold", "pii-safe"):
    _sev = "error" if _pack == "legal-hold" else "warning"
    add(f"q06_pack_{_pack.replace('-', '_')}", on(lambda t, p=_pack: quality.pack_findings(t, p), "canonical_docs"),
        f"select canon_id, 'sources-required' as rule, 'error' as severity from canonical_docs where source_uri is null union all select canon_id, 'review-pending', '{_sev}' from canonical_docs where coalesce(okf_verified, 'human:pending') = 'human:pending'" + (" union all select canon_id, 'redaction-proposed', 'warning' from canonical_docs where regexp_matches(body_md, '\\bsk-[A-Za-z0-9_-]{20,}\\b')" if _pack == "pii-safe" else ""))


def _ready(profile: str) -> Query:
    def f(s: SparkSession, d: str) -> DataFrame:
        n = _chunks(s, d).groupBy("source_sha256").agg(F.count("*").alias("n_chunks"))
        return quality.readiness(table(s, d, "canonical_docs").join(n, "source_sha256", "left"), NOW, profile)

    return f


for _profile, (_low, _high) in quality.PROFILES.items():
    add(f"q07_readiness_{_profile}", _ready(_profile),
        f"with {DELIVERED}, n as (select source_sha256, count(*) as n from delivered group by 1), s as (select canon_id, round(greatest(0.0, least(1.0, 1.0 - (case when d.source_sha256 is null then 0.1 else 0.0 end + case when coalesce(n, 0) = 0 then 0.1 else 0.0 end + case when metadata['ocr_enabled'] = 'true' then 0.1 else 0.0 end + case when okf_stale_after is null then 0.1 when okf_stale_after < '{NOW}' then 0.2 else 0.0 end + case when okf_verified like 'human:%' and okf_verified <> 'human:pending' then 0.0 else 0.3 end)::double)), 9) as score from canonical_docs d left join n on n.source_sha256 = d.source_sha256) select canon_id, score, case when score <= 0 or score < {_low} then 'blocked' when score < {_high} then 'needs_review' else 'ready' end as grade from s")
_QUEUE_SQL = f"select canon_id, source_sha256, round(case when okf_verified = 'human:pending' then 1.0 else 0.0 end + case when metadata['ocr_enabled'] = 'true' then 1.0 else 0.0 end + case when okf_stale_after < '{NOW}' then 1.0 else 0.0 end + coalesce(round(0.5 * least(1.0, greatest(0.0, date_diff('day', cast(converted_at as date), date '{NOW}') / 365.0)), 9), 0.0)::double, 9) as priority from canonical_docs"
add("q09_queue", on(lambda t: quality.queue(t, NOW), "canonical_docs"), _QUEUE_SQL)
add("q09_queue_top", on(lambda t: quality.queue(t, NOW, 25), "canonical_docs"), f"{_QUEUE_SQL} order by priority desc, source_sha256, canon_id limit 25")
add("q12_queue_states", on(lambda e: quality.queue_states(e.select(F.col("user_id").alias("item"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("state"))).select("item", "state"), "events"),
    "select user_id as item, arg_max(event_type, (ts, event_id)) as state from events group by user_id")
add("q14_pending", on(lambda t: t.where("okf_verified = 'human:pending'").select("canon_id"), "canonical_docs"), "select canon_id from canonical_docs where okf_verified = 'human:pending'")
add("q16_health", lambda s, d: quality.health(concepts.canonical_concepts(table(s, d, "canonical_docs")).agg(F.count("*").alias("total")), _doc_links(s, d).where("not exists").agg(F.count("*").alias("errors"))),
    f"with {_LINKS_SQL}, e as (select count(*) as errors from q where source <> target and target not in (select concept_id from latest)), t as (select count(*) as total from latest) select total, errors, cast(round_even(100.0 * (total - errors) / total, 0) as bigint) as score from t, e")
add("q16_orphans", lambda s, d: graph.orphans(concepts.canonical_concepts(table(s, d, "canonical_docs")), _doc_links(s, d)),
    f"with {_LINKS_SQL}, r as (select * from q where source <> target and target in (select concept_id from latest)) select concept_id from latest where concept_id not in (select source from r union select target from r)")


def _notes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.concat(F.lit("key sk-"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 24), F.lit(" end")).alias("note"))


add("q17_redactions", lambda s, d: quality.secrets(_notes(s, d), "event_id", "note").select("event_id", F.col("ordinal").cast("bigint").alias("ordinal"), "value_sha256"),
    "select event_id, 1::bigint as ordinal, sha256('sk-' || substr(sha256(cast(event_id as varchar)), 1, 24)) as value_sha256 from events")
add("k14_redacted", lambda s, d: _notes(s, d).select("event_id", quality.without_secrets(F.col("note")).alias("note")), "select event_id, 'key [REDACTED] end' as note from events")

# ---- reports -----------------------------------------------------------------------------------------------------


def _runs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(reports.distinct_runs(table(s, d, "run_results")))


add("g01_status", _runs(reports.by_status), f"with {RUNS} select status, count(*) as n from runs group by status")
add("g01_success", _runs(reports.success_rate), f"with {RUNS} select count(*) as n_results, count(*) filter (where status = 'ok') as n_ok, printf('%.1f%%', 100.0 * count(*) filter (where status = 'ok') / count(*)) as success from runs")
add("g02_engine", _runs(reports.by_engine), f"with {RUNS} select coalesce(nullif(engine, ''), 'unknown') as engine, count(*) as n, count(*) filter (where status = 'ok') as n_ok, count(*) filter (where status = 'failed') as n_failed, round(count(*) filter (where status = 'failed') / count(*), 6) as error_rate, round(avg(duration_seconds), 6) as avg_seconds from runs group by 1")
add("g03_codes", _runs(reports.codes), f"with {RUNS}, x as (select unnest(diagnostics) as d from runs) select d.code as code, d.severity as severity, count(*) as n from x group by all")
add("g04_top_errors", _runs(reports.top_errors), f"with {RUNS}, e as (select substr(replace(coalesce(error_text, ''), '|', '\\|'), 1, 120) as error, count(*) as n from runs where status = 'failed' group by 1), t as (select * from e order by n desc, error limit 10) select * from t union all select '(others)', cast((select coalesce(sum(n), 0) from e) - (select coalesce(sum(n), 0) from t) as bigint)")
add("g05_matrix", _runs(reports.engine_matrix), f"with {RUNS} select coalesce(engine, 'unknown') as engine, status, count(*) as n from runs group by all")
add("g06_history", _runs(reports.merged_history), f"with {RUNS}, r as (select run_no, count(*) as n, count(*) filter (where status = 'ok') as n_ok from runs group by run_no) select *, cast(sum(n) over (order by run_no) as bigint) as total_to_date from r order by run_no desc limit 20")
add("k06_dir_index", on(lambda t: reports.directory_index(concepts.canonical_concepts(t)), "canonical_docs"), f"with {LATEST} select coalesce(nullif(regexp_extract(concept_id, '^(.*)/[^/]*$', 1), ''), '.') as dir, count(*) as n, min(concept_id) as first, max(concept_id) as last from latest group by 1")
add("k03_collisions", on(reports.collisions, "canonical_docs"), f"select {CONCEPT} as concept_id, count(distinct source_relpath) as n_sources from canonical_docs where source_relpath is not null group by 1 having count(distinct source_relpath) > 1")
add("w04_attachment_budget", on(lambda t: reports.attachment_budget(t, 800_000, 3, 1_500_000), "canonical_docs"))
add("w06_first_wins", on(lambda t: claims.first_per(t.where("text is not null"), "bundle", [F.col("doc_id")]).select("bundle", "doc_id"), "documents"), "select bundle, min(doc_id) as doc_id from documents where text is not null group by bundle")

# ---- incremental -------------------------------------------------------------------------------------------------

_FILES_SQL = "files as (select source_relpath as relpath, source_sha256 as sha256 from canonical_docs where source_relpath is not null qualify row_number() over (partition by source_relpath order by converted_at desc, canon_id desc) = 1)"
add("y03_cache_skip", lambda s, d: incremental.cached(table(s, d, "run_results"), incremental.current_files(table(s, d, "canonical_docs"))),
    f"with {_FILES_SQL} select relpath, sha256, exists (select 1 from run_results r where r.status = 'ok' and r.relpath = files.relpath and r.sha256 = files.sha256) as cached from files")
add("y05_sync_merge", lambda s, d: incremental.sync_merge(table(s, d, "sync_records"), incremental.current_files(table(s, d, "canonical_docs"))),
    f"with {_FILES_SQL}, o as (select sha256 as source_sha256, min(relpath) as p from files group by 1) select source_sha256, coalesce(p, current_relpath) as current_relpath, case when generation is null then 1 when p is null then generation else generation + 1 end::int as generation from sync_records full join o using (source_sha256)")
add("y06_reconcile", lambda s, d: incremental.reconcile(table(s, d, "sync_records"), incremental.current_files(table(s, d, "canonical_docs"))),
    f"with {_FILES_SQL}, f as (select sha256 as source_sha256, min(relpath) as p from files group by 1) select source_sha256, case when p is null then 'deleted_candidate' when p <> current_relpath then 'renamed' else 'unchanged' end as action from sync_records left join f using (source_sha256)")
add("y02_debounce_sessions", on(lambda e: e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("n_batches"), F.sum("n").alias("n_events")), "events"),
    "with g as (select user_id, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as b from events window w as (partition by user_id order by ts)) select user_id, cast(sum(b) as bigint) as n_batches, count(*) as n_events from g group by user_id")

#: engines, their suffixes and priority (fixed values)
ENGINES = [("eml", [".eml"], 10), ("msg", [".msg"], 10), ("pst", [".pst"], 10), ("html", [".html", ".htm"], 10), ("md", [".md", ".markdown"], 10), ("txt", [".txt"], 10), ("officecli", [".docx", ".xlsx", ".pptx"], 10), ("odf", [".odt", ".ods", ".odp"], 10), ("rtf", [".rtf"], 10), ("pdf", [".pdf"], 10), ("all2md", [".pdf", ".docx", ".rtf"], 90)]


def _plan(s: SparkSession, d: str) -> DataFrame:
    caps = s.createDataFrame(ENGINES, "engine string, extensions array<string>, priority int")
    files = table(s, d, "canonical_docs").where("source_relpath is not null").select(F.col("source_relpath").alias("relpath")).distinct()
    return incremental.engine_plan(caps, files, "all2md")


add("s12_engine_plan", _plan,
    "with c as (select * from (values " + ", ".join(f"('{e}', {x}, {p})" for e, x, p in ENGINES) + ") t(engine, extensions, priority)), f as (select distinct source_relpath as relpath, lower(regexp_extract(source_relpath, '(\\.[^./]+)$', 1)) as ext from canonical_docs where source_relpath is not null) select relpath, engine, cast(row_number() over (partition by relpath order by case when engine = 'all2md' then 0 else 1 end, priority, engine) as int) as rank from f join c on list_contains(extensions, ext)")

# ---- vectors, attestation, mini SQL ------------------------------------------------------------------------------

add("v02_cache_miss", on(lambda e: vectors.misses(e.select(F.col("vec_id").cast("string").alias("key"), "label"), e.where("label % 3 = 0").select(F.col("vec_id").cast("string").alias("key"))), "embeddings"), "select cast(vec_id as varchar) as key, label from embeddings where not label % 3 = 0")
add("v03_prune", on(lambda e: vectors.prune(e.select("vec_id", "label"), e.where("label > 2"), "vec_id"), "embeddings"), "select vec_id, label from embeddings where label > 2")
add("v04_compatible", on(vectors.compatible, "embeddings"), "select count(*) as n_vectors, cast(min(len(embedding)) as int) as min_dimension, cast(max(len(embedding)) as int) as max_dimension, min(len(embedding)) = max(len(embedding)) as ok from embeddings")
add("v07_cosine_topk", on(lambda e: vectors.nearest(e, e.where("vec_id % 20 = 0"), 5), "embeddings"),
    "with p as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) as c from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id), r as (select *, row_number() over (partition by query_id order by round(c, 9) desc, vec_id) as rank from p) select query_id, vec_id, cast(rank as int) as rank, round(c, 6) as cosine from r where rank <= 5")
_LEAVES_SQL = f"{LATEST}, leaves as (select concept_id as path, sha256(regexp_replace(regexp_replace(coalesce(body_md, ''), '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g')) as leaf from latest)"


def _leaves(s: SparkSession, d: str) -> DataFrame:
    return attest.leaves(concepts.canonical_concepts(table(s, d, "canonical_docs")), "concept_id", "body_md")


add("h01_leaves", _leaves, f"with {_LEAVES_SQL} select * from leaves")
add("h02_merkle_root", lambda s, d: attest.merkle_root(_leaves(s, d)))
add("h03_proofs", lambda s, d: attest.proofs(_leaves(s, d)))
add("h04_verify", lambda s, d: attest.verify(_leaves(s, d), _leaves(s, d).where("path not like '%5.md'").withColumn("leaf", F.when(F.col("path").like("%7.md"), F.lit("0")).otherwise(F.col("leaf")))).groupBy("state").agg(F.count("*").alias("n")),
    f"with {_LEAVES_SQL} select case when path like '%5.md' then 'unexpected' when path like '%7.md' then 'changed' else 'ok' end as state, count(*) as n from leaves group by 1")


def _mini(sql: str) -> Query:
    def f(s: SparkSession, d: str) -> DataFrame:
        c = concepts.canonical_concepts(table(s, d, "canonical_docs")).select("concept_id", "title", F.col("okf_type").alias("type"), F.col("okf_status").alias("status"), "bundle")
        return minisql.run(sql, {"concepts": c, "links": _doc_links(s, d).select("source", "target")})

    return f


_MINI = f"{LATEST}, concepts as (select concept_id, title, okf_type as type, okf_status as status, bundle from latest)"
add("l01_sql_eq", _mini("SELECT concept_id, title FROM concepts WHERE type = 'Note'"), f"with {_MINI} select concept_id, title from concepts where coalesce(type, '') = 'Note'")
add("l01_sql_ne", _mini("SELECT concept_id FROM concepts WHERE status != unverified"), f"with {_MINI} select concept_id from concepts where coalesce(status, '') <> 'unverified'")
add("l01_sql_like", _mini("SELECT concept_id FROM concepts WHERE title LIKE '^(guide|reading)'"), f"with {_MINI} select concept_id from concepts where regexp_matches(coalesce(title, ''), '(?i)^(guide|reading)')")
add("l01_sql_in", _mini("SELECT concept_id FROM concepts WHERE bundle IN (@intake-notes, @tender-box)"), f"with {_MINI} select concept_id from concepts where bundle in ('@intake-notes', '@tender-box')")

# ---- sources, emitters, differences, streams ---------------------------------------------------------------------

from sheafline.operators import diff, emit  # noqa: E402
from sheafline.sources import adapters  # noqa: E402
from sheafline.streaming import watch  # noqa: E402


def _extracted(s: SparkSession, d: str, source: str, path: Column, content: Column, cond: str = "true") -> DataFrame:
    return adapters.extract(table(s, d, source).where(cond).select(path.alias("relpath"), F.encode(content, "UTF-8").alias("content")))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_STR = lambda c: F.col(c).cast("string")
add("a01_txt", lambda s, d: _extracted(s, d, "documents", F.concat(F.lit("in/"), _STR("doc_id"), F.lit(".txt")), F.col("text"), "text is not null").select("relpath", F.length("body_md").cast("bigint").alias("n")),
    f"select 'in/' || doc_id || '.txt' as relpath, cast(8 + length(regexp_replace(text, '{SPACE}+$', '')) + 5 as bigint) as n from documents where text is not null")
_PAGE = lambda: F.concat(F.lit("<html><head><title>Site</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><main><h1>"), _escaped(F.col("title")), F.lit("</h1><p>One <b>two</b>.</p></main><footer>Imprint</footer></body></html>"))
add("a03_html_title", lambda s, d: _extracted(s, d, "canonical_docs", F.concat(F.lit("web/"), _STR("canon_id"), F.lit(".html")), _PAGE(), "title is not null and trim(title) <> ''").select("relpath", "engine", "title"),
    f"select 'web/' || canon_id || '.html' as relpath, 'html' as engine, trim(regexp_replace(title, '{SPACE}+', ' ', 'g')) as title from canonical_docs where title is not null and trim(title) <> ''")
add("a03_html_md", lambda s, d: _extracted(s, d, "canonical_docs", F.concat(F.lit("web/"), _STR("canon_id"), F.lit(".html")), _PAGE(), "title is not null and trim(title) <> ''").select("relpath", F.contains("body_md", F.lit("Imprint")).alias("furniture"), F.contains("body_md", F.lit("One **two**.")).alias("article")),
    "select 'web/' || canon_id || '.html' as relpath, false as furniture, true as article from canonical_docs where title is not null and trim(title) <> ''")
add("a04_csv_table", lambda s, d: _extracted(s, d, "customer", F.concat(F.lit("csv/"), _STR("c_custkey"), F.lit(".csv")), F.concat(F.lit("name;segment\n"), F.col("c_name"), F.lit(";"), F.col("c_mktsegment"), F.lit("\n"))).select("relpath", "body_md"),
    "select 'csv/' || c_custkey || '.csv' as relpath, '| name | segment |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || c_mktsegment || ' |' || chr(10) || chr(10) || '_1 rows × 2 columns_' || chr(10) as body_md from customer")
add("a06_json_title", lambda s, d: _extracted(s, d, "customer", F.concat(F.lit("json/"), _STR("c_custkey"), F.lit(".json")), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("key")))).select("relpath", "title"),
    "select 'json/' || c_custkey || '.json' as relpath, c_name as title from customer")
_MAIL = lambda: F.concat(F.lit("From: a@example.org\r\nTo: b@example.org\r\nSubject: Note "), _STR("c_custkey"), F.lit("\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"), F.col("c_name"), F.lit("\r\n"))
add("a07_eml", lambda s, d: _extracted(s, d, "customer", F.concat(F.lit("mail/"), _STR("c_custkey"), F.lit(".eml")), _MAIL()).select("relpath", "title", F.contains("body_md", F.lit("## Body")).alias("has_body")),
    "select 'mail/' || c_custkey || '.eml' as relpath, 'Note ' || c_custkey as title, true as has_body from customer")
add("a09_messages", lambda s, d: _extracted(s, d, "nation", F.concat(F.lit("box/"), F.col("n_name"), F.lit(".mbox")), F.concat(F.lit("From a@example.org Mon Jan  1 00:00:00 2024\nSubject: one\n\nfirst\n\nFrom b@example.org Mon Jan  1 00:00:00 2024\nSubject: two\n\n"), F.col("n_name"), F.lit("\n"))).select("relpath", F.col("message_index").cast("bigint").alias("message_index"), "title"),
    "select 'box/' || n_name || '.mbox' as relpath, i as message_index, n_name || ' — ' || (case when i = 0 then 'one' else 'two' end) as title from nation, (select unnest([0::bigint, 1::bigint]) as i)")
add("a11_rtf", lambda s, d: _extracted(s, d, "nation", F.concat(F.col("n_name"), F.lit(".rtf")), F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}\\f0 "), F.col("n_name"), F.lit("\\par caf\\'e9}"))).select("relpath", "body_md"),
    "select n_name || '.rtf' as relpath, n_name || chr(10) || 'café' || chr(10) as body_md from nation")
add("a17_failures", lambda s, d: _extracted(s, d, "canonical_docs", F.col("source_relpath"), F.lit("no such file"), "source_relpath is not null").groupBy("engine", "status").agg(F.count("*").alias("n")))
add("s04_inspect", lambda s, d: adapters.inspected(table(s, d, "documents").select(F.concat(_STR("doc_id"), F.when(F.col("doc_id") % 3 == 0, ".pdf").otherwise(".docx")).alias("relpath"), F.encode(F.when(F.col("doc_id") % 2 == 0, "%PDF-1.7").otherwise("PK\x03\x04 broken"), "UTF-8").alias("content"))).select("relpath", "findings", "disposition"),
    "select doc_id || case when doc_id % 3 = 0 then '.pdf' else '.docx' end as relpath, case when doc_id % 3 = 0 and doc_id % 2 = 0 then '' when doc_id % 3 = 0 then 'type_mismatch,malformed_archive' when doc_id % 2 = 0 then 'type_mismatch' else 'malformed_archive' end as findings, case when doc_id % 3 = 0 and doc_id % 2 = 0 then 'allow' else 'quarantine' end as disposition from documents")
add("k03_concept_files", on(lambda t: emit.concept_files(t).select("path", F.length("text").cast("bigint").alias("n")), "canonical_docs"))
add("k04_wiki_fields", on(emit.wiki_fields, "canonical_docs"), "select canon_id, replace(source_uri, ':', '_') as source, source_sha256 as sha256, replace(okf_generated, ':', '_') as generated_by, replace(okf_verified, ':', '_') as verified_by, okf_stale_after as stale_on from canonical_docs")
add("k12_webhook", _runs(emit.webhook_payload))
add("fn12_cells", lambda s, d: diff.cells(_orders(s, d), "concept_id", "body").groupBy("concept_id").agg(F.count("*").alias("n_cells"), F.max("row").cast("bigint").alias("last_row")),
    "select 'orders/' || o_orderkey || '.md' as concept_id, 3 * (count(l_orderkey) + 1) as n_cells, count(l_orderkey) as last_row from orders join customer on c_custkey = o_custkey left join lineitem on l_orderkey = o_orderkey group by o_orderkey")


def _cell_diff(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d)
    left = diff.cells(o, "concept_id", "body")
    right = left.where("not (row = 2 and concept_id like '%3.md')").withColumn("value", F.when((F.col("row") == 1) & (F.col("col") == 2), F.concat("value", F.lit("x"))).otherwise(F.col("value")))
    return diff.cell_changes(left, right, "concept_id").groupBy("concept_id").agg(F.count("*").alias("n_changed"))


add("d07_cell_diff", _cell_diff,
    "with n as (select o_orderkey, count(l_orderkey) as n from orders join customer on c_custkey = o_custkey left join lineitem on l_orderkey = o_orderkey group by o_orderkey) select 'orders/' || o_orderkey || '.md' as concept_id, (case when n >= 1 then 1 else 0 end + case when n >= 2 and o_orderkey % 10 = 3 then 3 else 0 end)::bigint as n_changed from n where n >= 1")


def _reconverted(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "canonical_docs").where("body_md is not null and source_relpath is not null")
    g = docs.groupBy("source_relpath").agg(F.min_by("body_md", "canon_id").alias("left"), F.max_by("body_md", "canon_id").alias("right"), F.count("*").alias("n")).where("n > 1")
    return diff.document_changes(g, "source_relpath")


add("d05_element_diff", lambda s, d: _reconverted(s, d).groupBy("key", "status").agg(F.count("*").alias("n")))
add("d08_change_counts", lambda s, d: diff.change_counts(_reconverted(s, d)))


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The debounce over a stream of all events, read until nothing is left."""
    import uuid

    from sheafline.session import checkpoint_dir

    folder = f"{checkpoint_dir(s)}/debounced_{uuid.uuid4().hex[:12]}"
    events = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    # complete results go to the shared folder, not to the driver's memory
    save = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")
    watch.debounced(events, late="3650 days").writeStream.foreachBatch(save).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.count("*").alias("n_batches"), F.sum("n").alias("n_events"))


add("y01_stream_debounce", _stream, _SQL["y02_debounce_sessions"])

# ---- front door, benchmarks, small functions ---------------------------------------------------------------------

from sheafline.functions.snippet import snippets  # noqa: E402
from sheafline.operators import benchmark  # noqa: E402

add("x08_snippets", lambda s, d: search.match(_chunks(s, d).where("text is not null"), "ledger cabinet").select("id", snippets(F.col("text"), ["ledger", "cabinet"]).alias("snippet")))
add("q18_anchor_recall", on(lambda t: t.where("body_md is not null and title is not null").select("canon_id", F.round(benchmark.anchor_recall(F.col("body_md"), F.array("title", F.lit("the"))), 6).alias("recall")), "canonical_docs"),
    "select canon_id, round((case when contains(body_md, title) then 1 else 0 end + case when contains(body_md, 'the') then 1 else 0 end) / 2.0::double, 6) as recall from canonical_docs where body_md is not null and title is not null")


def _engine_deltas(s: SparkSession, d: str) -> DataFrame:
    r = reports.distinct_runs(table(s, d, "run_results")).where("engine is not null")
    # sums of decimals are exact, so no order of addition moves a difference over a half
    mean = lambda c: F.sum(F.col(c).cast("decimal(20,9)")).cast("double") / F.count(c)
    m = lambda cond: r.where(cond).groupBy("engine").agg(mean("duration_seconds").alias("seconds"), mean("confidence").alias("confidence"))
    return benchmark.deltas(m("finished_at >= timestamp'2025-01-01'"), m("finished_at < timestamp'2025-01-01'"), "engine", ("seconds", "confidence"))


add("q19_deltas", _engine_deltas,
    f"with {RUNS}, m as (select engine, finished_at >= timestamp '2025-01-01' as late, cast(sum(cast(duration_seconds as decimal(20,9))) as double) / count(duration_seconds) as seconds, cast(sum(cast(confidence as decimal(20,9))) as double) / count(confidence) as confidence from runs where engine is not null group by all), j as (select c.engine, c.seconds - b.seconds as s, c.confidence - b.confidence as k from m c join m b using (engine) where c.late and not b.late) select engine, 'seconds' as metric, round(s, 6) as delta from j union all select engine, 'confidence', round(k, 6) from j")
add("fn20_uri_path", on(lambda t: t.where("source_uri is not null").select("canon_id", F.regexp_replace("source_uri", "^[a-z]+://[^/]*/", "").alias("path")), "canonical_docs"),
    "select canon_id, regexp_replace(source_uri, '^[a-z]+://[^/]*/', '') as path from canonical_docs where source_uri is not null")
add("fn24_node_size", on(lambda t: t.where("source_relpath is not null").select("canon_id", F.greatest(F.lit(24), F.least(F.lit(70), 24 + F.floor(F.length(F.coalesce("body_md", F.lit(""))) / 200))).cast("bigint").alias("size"), F.when(F.col("source_relpath").contains("/"), F.substring_index("source_relpath", "/", 1)).otherwise("(root)").alias("grp")), "canonical_docs"),
    "select canon_id, greatest(24, least(70, 24 + length(coalesce(body_md, '')) // 200)) as size, case when contains(source_relpath, '/') then split_part(source_relpath, '/', 1) else '(root)' end as grp from canonical_docs where source_relpath is not null")
add("fn29_confidence", on(lambda r: r.select("result_id", benchmark.confidence(F.col("status") == "ok", F.col("engine").isNotNull(), F.coalesce(F.col("confidence") > 0.5, F.lit(False)), F.size("diagnostics") == 0, F.exists("diagnostics", lambda x: x["code"] == "OCR_LOW")).alias("score")).distinct(), "run_results"),
    "select distinct result_id, round(case when status = 'ok' then 0.4 else 0 end + case when engine is not null then 0.3 else 0 end - case when engine is not null and len(list_filter(diagnostics, lambda x: x.code = 'OCR_LOW')) > 0 then 0.1 else 0 end + case when coalesce(confidence > 0.5, false) then 0.2 else 0 end + case when len(diagnostics) = 0 then 0.1 else 0 end::double, 6)::double as score from run_results")
add("s11_bundles", lambda s, d: table(s, d, "bundle_registry").join(table(s, d, "canonical_docs").groupBy(F.col("bundle").alias("slug")).agg(F.count("*").alias("n_docs")), "slug", "left").select("slug", "bundle_path", F.coalesce("n_docs", F.lit(0)).alias("n_docs")),
    "select slug, bundle_path, count(canon_id) as n_docs from bundle_registry left join canonical_docs on bundle = slug group by all")
add("k01_rendered", on(lambda t: spread(t).where("body_md is not null").select("canon_id", F.length(emit.rendered(concepts.block_array(F.col("body_md")))).alias("n_chars")).where("n_chars > 0"), "canonical_docs"))
add("h05_provenance", on(lambda t: t.where(F.col("source_sha256").rlike(text.SHA256) & F.col("source_uri").isNotNull()).groupBy("source_sha256").agg(F.min("source_uri").alias("source_uri"), F.countDistinct("source_uri").alias("n_uris")), "canonical_docs"),
    "select source_sha256, min(source_uri) as source_uri, count(distinct source_uri) as n_uris from canonical_docs where regexp_full_match(source_sha256, '[0-9a-f]{64}') and source_uri is not null group by 1")
add("u02_lost_chunks", lambda s, d: _chunks(s, d).select("source_sha256").distinct().exceptAll(table(s, d, "canonical_docs").select("source_sha256").distinct()), "select distinct source_sha256 from chunks where source_sha256 is not null except select source_sha256 from canonical_docs")

# ---- reviews, snapshots of states, joins the front ends use --------------------------------------------------------

from sheafline.operators import review  # noqa: E402


def _review_log(e: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "decide").when(F.col("event_type") == "error", "suppress")
    return review.fold(e.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 3).alias("reviewer")).where("action is not null"))


add("q13_review_log", on(_review_log, "events"),
    "with e as (select user_id as item, event_id as seq, case event_type when 'click' then 'claim' when 'purchase' then 'decide' when 'error' then 'suppress' end as action, event_id % 3 as reviewer from events where event_type in ('click', 'purchase', 'error')), c as (select item, arg_min(reviewer, seq) as holder, min(seq) as claimed_at from e where action = 'claim' group by item), v as (select e.*, holder, coalesce(action = 'suppress' or (reviewer = holder and seq >= claimed_at), false) as valid from e left join c using (item)) select item, case when bool_or(valid and action = 'suppress') then 'suppressed' when bool_or(valid and action = 'decide') then 'decided' when bool_or(valid and action = 'claim') then 'claimed' else 'open' end as state, max(holder) as reviewer, count(*) filter (where not valid) as rejected from v group by item")
add("q15_evidence", lambda s, d: review.evidence_packet(table(s, d, "canonical_docs"), _chunks(s, d)).select("canon_id", "id", "page"),
    f"with {DELIVERED}, j as (select canon_id, id, citation.page as page, row_number() over (partition by canon_id order by ordinal, id) as r from canonical_docs d join delivered c on c.source_sha256 = d.source_sha256 where okf_verified = 'human:pending') select canon_id, id, page from j where r <= 5")
add("j04_index_vs_docs", lambda s, d: _chunks(s, d).groupBy("source_sha256").agg(F.count("*").alias("n_chunks")).join(table(s, d, "canonical_docs").groupBy("source_sha256").agg(F.count("*").alias("n_docs")), "source_sha256", "full_outer").groupBy(F.col("n_chunks").isNull().alias("no_chunks"), F.col("n_docs").isNull().alias("no_docs")).agg(F.count("*").alias("n")),
    f"with {DELIVERED}, c as (select source_sha256, count(*) as n from delivered group by 1), t as (select source_sha256, count(*) as n from canonical_docs group by 1) select c.n is null as no_chunks, t.n is null as no_docs, count(*) as n from c full join t using (source_sha256) group by all")
add("w02_heading_steps", on(lambda t: _heading_steps(t), "canonical_docs"),
    f"with {_LINES_SQL}, h as (select canon_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) as lv from lines), k as (select canon_id, lv - lag(lv) over (partition by canon_id order by line_no) as step from h where lv > 0) select step, count(*) as n from k where step is not null group by step")


def _heading_steps(docs: DataFrame) -> DataFrame:
    """How often each step between the levels of consecutive headings occurs."""
    from pyspark.sql import Window

    lines = docs.where("body_md is not null").select("canon_id", F.posexplode(F.split("body_md", "\n")).alias("line_no", "line"))
    heads = lines.withColumn("level", F.length(F.regexp_extract("line", "^(#{1,6})\\s", 1))).where("level > 0")
    step = F.col("level") - F.lag("level").over(Window.partitionBy("canon_id").orderBy("line_no"))
    return heads.withColumn("step", step.cast("bigint")).where("step is not null").groupBy("step").agg(F.count("*").alias("n"))


def _scored_pairs(s: SparkSession, d: str) -> DataFrame:
    """Edit similarity of a document's first and last conversion; candidate pairs are given, none are enumerated."""
    docs = table(s, d, "canonical_docs").where("body_md is not null and source_relpath is not null")
    g = docs.groupBy("source_relpath").agg(F.min("canon_id").alias("a"), F.max("canon_id").alias("b"), F.min_by("body_md", "canon_id").alias("left_content"), F.max_by("body_md", "canon_id").alias("right_content"), F.min_by("title", "canon_id").alias("left_title"), F.max_by("title", "canon_id").alias("right_title")).where("a < b")
    return dedupe.similarity_scores(g.select(F.col("a").cast("string").alias("left_id"), F.col("b").cast("string").alias("right_id"), "left_content", "right_content", "left_title", "right_title"), ("content", "title"))


add("d03_edit_similarity", _scored_pairs)


def _planned(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "canonical_docs").where("source_relpath is not null").select(F.col("source_relpath").alias("relpath"), F.encode(F.coalesce("title", F.lit("")), "UTF-8").alias("content"))
    return adapters.extract_planned(files, {"pdf": ["txt"], "office": ["txt"], "odf": ["txt"]}).groupBy("engine", "status", F.size("attempts").alias("n_attempts")).agg(F.count("*").alias("n"))


add("a20_planned_adapters", _planned)
add("a21_normalized", lambda s, d: adapters.normalize(_extracted(s, d, "customer", F.concat(F.lit("txt/"), _STR("c_custkey"), F.lit(".txt")), F.col("c_name")), table(s, d, "customer").select(F.concat(F.lit("txt/"), _STR("c_custkey"), F.lit(".txt")).alias("relpath"), F.sha2("c_name", 256).alias("sha256"))).select("relpath", "title", "source_format", "source_sha256", "body_md"),
    "select 'txt/' || c_custkey || '.txt' as relpath, cast(c_custkey as varchar) as title, '.txt' as source_format, sha256(c_name) as source_sha256, '```text' || chr(10) || c_name || chr(10) || '```' || chr(10) as body_md from customer")
