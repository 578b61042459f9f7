"""Further queries of the core with their SQL twins: the stored index, findings, factors, outputs, attestation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.operators import attest, claims, diff, factors, index_store, outputs, vectors
from sheafline.operators.reports import distinct_runs
from sheafline.plans import registry
from sheafline.plans.registry import _LEAVES_SQL, CONCEPT, DELIVERED, NOW, RUNS, _chunks, _leaves, _orders, _phrase_hits, _top_sql, _word_hits, add, on
from sheafline.session import checkpoint_dir, table
from sheafline.sources import adapters

# ---- stored index ------------------------------------------------------------------------------------------------


def _folder(s: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(s)}/{name}_{uuid.uuid4().hex[:12]}"


def _indexed(query: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        folder = _folder(s, "index")
        index_store.write(_chunks(s, d).where("concept_id is not null"), folder)
        return index_store.Index(s, folder).search(query).select("id", F.round("score", 6).alias("score"), "concept_id", "ordinal")

    return run


_PREFIX = "len(list_filter(ts, lambda x: starts_with(x, '{}')))"
for _name, _query, _hits, _cond in (
    ("and", "ledger cabinet", [_word_hits("ledger"), _word_hits("cabinet")], "tf0 > 0 and tf1 > 0"),
    ("or", "Feuchtigkeit OR humidity OR cabinet", [_word_hits("feuchtigkeit"), _word_hits("humidity"), _word_hits("cabinet")], "tf0 > 0 or tf1 > 0 or tf2 > 0"),
    ("phrase", '"scanned ledger"', [_phrase_hits(["scanned", "ledger"])], "tf0 > 0"),
    ("prefix", "conver*", [_PREFIX.format("conver")], "tf0 > 0"),
    ("nested", "ledger (cabinet OR archive)", [_word_hits("ledger"), _word_hits("cabinet"), _word_hits("archive")], "tf0 > 0 and (tf1 > 0 or tf2 > 0)"),
    ("not", "ledger NOT scanned", [_word_hits("ledger"), _word_hits("scanned")], None),
    ("first", "^the", ["case when ts[1] = 'the' then 1 else 0 end"], "tf0 > 0"),
):
    _sql = _top_sql(_hits, _cond) if _cond else _top_sql(_hits[:1], "tf0 > 0 and not list_contains(ts, 'scanned')").replace("len(ts) as dl,", "len(ts) as dl, ts,").replace("from l, s where", "from l, s where")
    add(f"x01_index_{_name}20", _indexed(_query), _sql)
registry._SQL["x09_top20"] = _top_sql([_word_hits("ledger"), _word_hits("cabinet")], "tf0 > 0 and tf1 > 0")
for _name, _query, _hits, _cond in (("prefix", "conver*", [_PREFIX.format("conver")], "tf0 > 0"), ("first", "^the", ["case when ts[1] = 'the' then 1 else 0 end"], "tf0 > 0")):
    add(f"x09_{_name}20", lambda s, d, q=_query: registry.search.search(_chunks(s, d).where("concept_id is not null"), q, 20).select("id", F.round("score", 6).alias("score"), "concept_id", "ordinal"), _top_sql(_hits, _cond))

# ---- findings of claims ------------------------------------------------------------------------------------------


def _doc_claims(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "canonical_docs").where("body_md is not null and source_sha256 is not null")
    return claims.claims(docs, "canon_id", "body_md", F.col("source_sha256"))


_RX = {"owner": "(?im)^owner:\\s*(.+)$", "amount": "\\$([0-9][0-9,]*(?:\\.[0-9]{2})?)\\b", "status_label": "(?im)^status:\\s*(.+)$", "date": "\\b([0-9]{4}-[0-9]{2}-[0-9]{2})\\b"}
_DOC_CLAIMS = "found as (" + " union all ".join(f"select source_sha256 as scope, '{k}' as kind, regexp_extract_all(body_md, '{rx}', 1) as v from canonical_docs where body_md is not null and source_sha256 is not null" for k, rx in _RX.items()) + f"), claims as (select scope, kind, lower(trim(regexp_replace(unnest(v), '{registry.SPACE}+', ' ', 'g'))) as value from found)"


def _findings_sql(cond: str) -> str:
    return f"with {_DOC_CLAIMS}, t as (select count(*) as total from claims), g as (select scope, kind, value, count(*) as n from claims where {cond} group by all) select 'claim_conflict' as finding, a.scope, a.kind, a.value as left_value, b.value as right_value, a.n * b.n as n_pairs from g a join g b on a.scope = b.scope and a.kind = b.kind and a.value < b.value, t where total <= 5000 union all select 'claims_too_many', null, null, null, null, total from t where total > 5000"


add("m04_findings", lambda s, d: claims.checked(_doc_claims(s, d)), _findings_sql("true"))
add("m06_policy", lambda s, d: claims.checked(_doc_claims(s, d), kinds_off=("date",)), _findings_sql("kind <> 'date'"))
add("m02_findings_capped", lambda s, d: claims.checked(_doc_claims(s, d), cap=3), f"with {_DOC_CLAIMS} select 'claims_too_many' as finding, null::varchar as scope, null::varchar as kind, null::varchar as left_value, null::varchar as right_value, count(*) as n_pairs from claims having count(*) > 3")

# ---- queue factors -----------------------------------------------------------------------------------------------

_FACTORS = {
    "diagnostic_severity": ("case when okf_verified = 'human:pending' then 1.0 else 0.0 end", 1.0),
    "ocr_fallback_state": ("case when metadata['ocr_enabled'] = 'true' then 1.0 else 0.0 end", 1.0),
    "sensitivity_findings": "",
    "policy_errors": ("case when coalesce(source_uri, '') = '' or coalesce(okf_type, '') = '' then 1.0 else 0.0 end", 1.0),
    "stale_state": (f"case when okf_stale_after < '{NOW}' then 1.0 else 0.0 end", 1.0),
    "age": (f"coalesce(least(1.0::double, greatest(0.0::double, date_diff('day', cast(converted_at as date), date '{NOW}') / 365.0::double)), 0.0)", 0.5),
}
_FACTORS["sensitivity_findings"] = ("coalesce(len(regexp_extract_all(body_md, '\\bsk-[A-Za-z0-9_-]{20,}\\b')), 0)", 1.0)


def _queue_sql(weights: dict[str, float]) -> str:
    return "select canon_id, source_sha256, round(" + " + ".join(f"round(({sql})::double * {weights.get(n, w)}::double, 9)" for n, (sql, w) in _FACTORS.items()) + ", 9) as priority from canonical_docs"


add("q10_contributions", on(lambda t: factors.Registry().contributions(t, NOW).groupBy("factor", "weight").agg(F.count_if(F.col("value") > 0).alias("n"), F.round(F.sum(F.col("contribution").cast("decimal(20,9)")).cast("double"), 6).alias("total")), "canonical_docs"),
    " union all ".join(f"select '{n}' as factor, {w}::double as weight, count(*) filter (where ({sql}) > 0) as n, round(cast(sum(cast(round(({sql})::double * {w}::double, 9) as decimal(20,9))) as double), 6) as total from canonical_docs" for n, (sql, w) in _FACTORS.items()))
add("q10_queue", on(lambda t: factors.Registry().queue(t, NOW), "canonical_docs"), _queue_sql({}))
add("q11_queue_weighted", on(lambda t: factors.Registry().queue(t, NOW, {"age": 2.0, "stale_state": 0.25}), "canonical_docs"), _queue_sql({"age": 2.0, "stale_state": 0.25}))

# ---- outputs -----------------------------------------------------------------------------------------------------

add("fn08_derived", on(lambda t: t.where("source_relpath is not null and engine is not null").select("canon_id", outputs.description(F.col("source_relpath"), F.col("engine")).alias("description")), "canonical_docs"),
    "select canon_id, 'Document derived from ' || source_relpath || ' via ' || engine || '.' as description from canonical_docs where source_relpath is not null and engine is not null")
add("fn21_timestamps", on(lambda t: t.select("canon_id", outputs.timestamp(F.concat("okf_stale_after", F.lit("T00:00:00Z"))).isNotNull().alias("strict"), outputs.timestamp(F.col("okf_stale_after")).isNotNull().alias("loose")), "canonical_docs"),
    "select canon_id, coalesce(try_strptime(okf_stale_after || 'T00:00:00Z', '%Y-%m-%dT%H:%M:%SZ') is not null, false) as strict, false as loose from canonical_docs")
add("y10_ttl", on(lambda t: t.where("converted_at is not null").select("canon_id", outputs.stale_after(F.to_date("converted_at")).alias("stale_after")), "canonical_docs"), "select canon_id, strftime(cast(converted_at as date) + 180, '%Y-%m-%d') as stale_after from canonical_docs where converted_at is not null")
add("k02_plain_files", on(lambda t: outputs.plain_files(t).select("path", F.sha2(F.regexp_extract("text", "(?s)^---\\n.*?\\n---\\n\\n(.*)$", 1), 256).alias("body_sha"), F.regexp_extract("text", "(?m)^sha256: '?([0-9a-f]*)'?$", 1).alias("sha256")), "canonical_docs"),
    "select source_relpath || '.md' as path, sha256(regexp_replace(coalesce(body_md, ''), '[\\s\\x0b]+$', '') || chr(10)) as body_sha, coalesce(source_sha256, '') as sha256 from canonical_docs where source_relpath is not null")
_ROWS = "r as (select o_orderkey, count(l_orderkey) as n, string_agg(l_linenumber || ',' || l_partkey || ',' || cast(l_quantity as bigint), chr(10) order by l_linenumber, l_partkey || ' | ' || cast(l_quantity as bigint)) as c, string_agg('{\"line\":\"' || l_linenumber || '\",\"part\":\"' || l_partkey || '\",\"qty\":\"' || cast(l_quantity as bigint) || '\"}', ',' order by l_linenumber, l_partkey || ' | ' || cast(l_quantity as bigint)) as j from orders join customer on c_custkey = o_custkey left join lineitem on l_orderkey = o_orderkey group by o_orderkey)"
add("k05_table_sidecars", lambda s, d: outputs.table_sidecars(diff.cells(_orders(s, d), "concept_id", "body"), "concept_id").select("concept_id", F.col("n_rows").cast("bigint").alias("n_rows"), "csv", "json"),
    f"with {_ROWS} select 'orders/' || o_orderkey || '.md' as concept_id, n as n_rows, 'line,part,qty' || chr(10) || case when n > 0 then c || chr(10) else '' end as csv, '[' || coalesce(j, '') || ']' as json from r")
add("k07_log", lambda s, d: outputs.log_entry(distinct_runs(table(s, d, "run_results"))),
    f"with {RUNS}, c as (select run_no, coalesce(engine, 'no-adapter') as engine, coalesce(status, 'unknown') as status, count(*) as n from runs group by all), p as (select run_no, engine, string_agg(n || ' ' || status, ', ' order by status) as bits, sum(n) as n from c group by all), s as (select run_no, string_agg('  - `' || engine || '`: ' || bits, chr(10) order by engine) as summary, sum(n) as total from p group by run_no), f as (select run_no, string_agg('  - ' || coalesce(relpath, '') || ': ' || error_text, chr(10) order by relpath nulls first, error_text) as errors from runs where status = 'failed' and error_text is not null and error_text <> '' group by run_no) select run_no, '- Total: ' || cast(total as bigint) || ' files' || chr(10) || chr(10) || '### Per-engine' || chr(10) || chr(10) || summary || chr(10) || case when errors is null then '' else chr(10) || '### Errors' || chr(10) || chr(10) || errors || chr(10) end as entry from s left join f using (run_no)")


def _manifest(s: SparkSession, d: str) -> DataFrame:
    """Two batches appended, the second one twice (as after a restart): every result is a line once."""
    folder = _folder(s, "manifest")
    lines = outputs.manifest_lines(distinct_runs(table(s, d, "run_results")))
    first = F.get_json_object("line", "$.run_no").cast("int") % 2 == 0
    outputs.append_lines(lines.where(first), folder, "0")
    outputs.append_lines(lines.where(~first), folder, "1")
    out = outputs.append_lines(lines.where(~first), folder, "1")
    field = lambda k: F.get_json_object("value", f"$.{k}")
    return out.select(field("run_no").cast("int").alias("run_no"), field("relpath").alias("relpath"), field("status").alias("status"), field("sha256").alias("sha256"), field("error").alias("error"))


add("k08_manifest", _manifest, f"with {RUNS} select run_no, relpath, status, sha256, error_text as error from runs")
registry._QUERIES["y04_resumed_append"], registry._SQL["y04_resumed_append"] = registry._QUERIES["k08_manifest"], registry._SQL["k08_manifest"]
add("k11_chunk_lines", lambda s, d: outputs.chunk_lines(_chunks(s, d)).select("id", F.get_json_object("line", "$.concept_id").alias("concept_id"), F.get_json_object("line", "$.citation.page").cast("int").alias("page"), F.sha2(F.get_json_object("line", "$.text"), 256).alias("text_sha")),
    f"with {DELIVERED} select id, concept_id, citation.page as page, sha256(text) as text_sha from delivered")
_FIX = f"select canon_id, source_relpath, regexp_extract({CONCEPT}, '([^/]+)$', 1) as target, array_to_string(list_filter([case when coalesce(okf_status, '') = '' then '+status' end, case when coalesce(okf_verified, '') = '' then '+verified' end, case when coalesce(okf_stale_after, '') = '' then '+stale_after' end], lambda x: x is not null), '; ') as additions, case when coalesce(okf_status, '') = '' then 'unverified' else okf_status end as status, case when coalesce(okf_verified, '') = '' then 'human:pending' else okf_verified end as verified, case when coalesce(okf_stale_after, '') = '' then strftime(date '{NOW}' + 180, '%Y-%m-%d') else okf_stale_after end as stale_after from canonical_docs where coalesce(okf_type, '') <> '' and coalesce(source_uri, '') <> '' and source_relpath is not null"
add("q04_safe_fixes", on(lambda t: outputs.safe_fixes(t, NOW), "canonical_docs"), f"with f as ({_FIX}) select canon_id, target, additions, status, verified, stale_after from f where additions <> '' and target <> 'index.md' qualify row_number() over (partition by target order by source_relpath desc, canon_id desc) = 1")
_FIRST_LAST = "g as (select source_relpath, arg_min({0}, canon_id) as l, arg_max({0}, canon_id) as r, count(*) as n from canonical_docs where source_relpath is not null {1} group by 1)"


def _conversions(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "canonical_docs").where("source_relpath is not null")
    names = ("title", "okf_type", "okf_status", "okf_generated", "okf_verified", "okf_stale_after")
    docs = docs.withColumn("fields", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])))
    return docs.groupBy("source_relpath").agg(F.min_by("fields", "canon_id").alias("left"), F.max_by("fields", "canon_id").alias("right"), F.count("*").alias("n")).where("n > 1")


_FM = "fm as (select source_relpath, unnest([" + ", ".join(f"{{'field': '{n}', 'before': l.{n}, 'after': r.{n}}}" for n in ("title", "okf_type", "okf_status", "okf_generated", "okf_verified", "okf_stale_after")) + "]) as x from g where n > 1), changed as (select source_relpath, x.field as field, x.before as before, x.after as after from fm where x.before is distinct from x.after)"
_FM = _FIRST_LAST.format("{'title': title, 'okf_type': okf_type, 'okf_status': okf_status, 'okf_generated': okf_generated, 'okf_verified': okf_verified, 'okf_stale_after': okf_stale_after}", "") + ", " + _FM
add("d08_frontmatter", lambda s, d: diff.frontmatter_changes(_conversions(s, d), "source_relpath"), f"with {_FM} select * from changed")
_CELL = "replace(replace(coalesce({}, ''), '|', '\\|'), chr(10), '<br>')"
add("d09_report", lambda s, d: diff.report(diff.frontmatter_changes(_conversions(s, d), "source_relpath").select("source_relpath", F.lit("modified").alias("status"), F.col("field").alias("kind"), "before", "after"), "source_relpath"),
    f"with {_FM} select source_relpath, '| Status | Count |' || chr(10) || '|---|---:|' || chr(10) || '| added | 0 |' || chr(10) || '| removed | 0 |' || chr(10) || '| modified | ' || count(*) || ' |' || chr(10) || '| moved | 0 |' || chr(10) || '| unchanged | 0 |' || chr(10) || chr(10) || '| Kind | Status | Left | Right |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || field || ' | modified | ' || {_CELL.format('before')} || ' | ' || {_CELL.format('after')} || ' |', chr(10) order by field) || chr(10) as report from changed group by source_relpath")


def _refresh(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "canonical_docs").where("source_relpath is not null")
    at = lambda cond: docs.where(cond).groupBy("source_relpath").agg(F.max_by("source_sha256", F.struct("converted_at", "canon_id")).alias("digest"))
    return outputs.refreshed(at("converted_at < timestamp'2025-01-01'"), at("converted_at >= timestamp'2024-09-01'"), "source_relpath", "digest")


add("d11_refresh", _refresh,
    "with o as (select source_relpath as p, arg_max(source_sha256, (converted_at, canon_id)) as g from canonical_docs where source_relpath is not null and converted_at < timestamp '2025-01-01' group by 1), n as (select source_relpath as p, arg_max(source_sha256, (converted_at, canon_id)) as g from canonical_docs where source_relpath is not null and converted_at >= timestamp '2024-09-01' group by 1), j as (select o.p is not null as was, n.p is not null as now, o.g as a, n.g as b from o full join n using (p)) select count(*) filter (where was) as n_before, count(*) filter (where now) as n_after, count(*) filter (where not was and now) as n_added, count(*) filter (where was and not now) as n_removed, count(*) filter (where was and now and a is distinct from b) as n_changed from j")
_HEADS = "list_transform(regexp_extract_all({}, '(?m)^#{{1,6}}[ \\t]+([^\\n]*)$', 1), lambda x: lower(rtrim(x, chr(13) || chr(9) || ' ')))"


def _same_headings(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "canonical_docs").where("source_relpath is not null and body_md is not null")
    heads = lambda c: F.transform(F.filter(F.split(c, "\n"), lambda x: x.rlike("^#{1,6}[ \t]+")), lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, "^#{1,6}[ \t]+", ""), "[\r\t ]+$", "")))
    g = docs.groupBy("source_relpath").agg(F.min_by("body_md", "canon_id").alias("l"), F.max_by("body_md", "canon_id").alias("r"), F.count("*").alias("n")).where("n > 1")
    return g.select("source_relpath", (heads(F.col("l")) == heads(F.col("r"))).alias("same"))


add("q20_render_same", _same_headings, f"with {_FIRST_LAST.format('body_md', 'and body_md is not null')} select source_relpath, {_HEADS.format('l')} = {_HEADS.format('r')} as same from g where n > 1")

# ---- attestation, vectors ----------------------------------------------------------------------------------------

_NODE = "sha256('\\x01'::blob || unhex(l) || unhex(r))"
registry._SQL["h02_merkle_root"] = f"with recursive {_LEAVES_SQL}, lv as (select 0 as lvl, row_number() over (order by path, leaf) - 1 as idx, leaf as node, count(*) over () as n from leaves union all select lvl + 1, idx // 2, case when count(*) = 2 then sha256('\\x01'::blob || unhex(arg_min(node, idx)) || unhex(arg_max(node, idx))) else min(node) end, (n + 1) // 2 from lv where n > 1 group by lvl, idx // 2, n) select (select count(*) from leaves) as n_leaves, node as root from lv where n = 1"


def _verified(s: SparkSession, d: str) -> DataFrame:
    own = _leaves(s, d)
    return attest.verified(own, own, attest.merkle_root(own).first().root)


add("h04_verified", _verified, f"with {_LEAVES_SQL} select true as map_ok, true as root_ok, true as proofs_ok, count(*) as n_ok, 0::bigint as n_changed, 0::bigint as n_missing, 0::bigint as n_unexpected from leaves")
add("h06_statement", lambda s, d: attest.statement(_leaves(s, d), "0" * 64).where(f"part > 0 and part < {2**62}"), f"with {_LEAVES_SQL} select row_number() over (order by path, leaf) as part, case when row_number() over (order by path, leaf) = 1 then '' else ',' end || '{{\"path\":' || to_json(path) || ',\"sha256\":\"' || leaf || '\"}}' as line from leaves")
add("fn26_canonical_json", on(lambda t: t.select("canon_id", attest.canonical_json({"status": F.col("okf_status"), "bundle": F.col("bundle"), "size": F.col("source_size_bytes")}).alias("json")), "canonical_docs"),
    "select canon_id, '{\"bundle\":' || coalesce(to_json(bundle), 'null') || ',\"size\":' || coalesce(cast(source_size_bytes as varchar), 'null') || ',\"status\":' || coalesce(to_json(okf_status), 'null') || '}' as json from canonical_docs")
add("g09_build_hash", lambda s, d: _chunks(s, d).groupBy("concept_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]), "\n"), 256).alias("hash")),
    f"with {DELIVERED} select concept_id, sha256(string_agg(id, chr(10) order by ordinal, id)) as hash from delivered group by concept_id")
add("v05_upsert", on(lambda e: vectors.upsert(e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("key"), "label"), e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("key"), (F.col("label") + 100).alias("label"), F.lit("dropped").alias("text"))), "embeddings"),
    "select vec_id as key, case when vec_id % 2 = 0 then label + 100 else label end as label from embeddings where vec_id % 2 = 0 or vec_id % 3 = 0")


def _refreshed_vectors(s: SparkSession, d: str) -> DataFrame:
    """A cache of the older chunks brought up to date with all: which vectors it then holds."""
    providers = vectors.Providers()
    providers.register("hashed", "signed-words", 16, "1", lambda c: vectors.hashed_embedding(c, 16))
    chunks = _chunks(s, d)
    empty = s.createDataFrame([], "key string, embedding array<double>")
    old = providers.refresh(empty, chunks.where("ordinal < 2"), "hashed")
    return providers.refresh(old, chunks.where("ordinal > 0"), "hashed").select("key", F.size("embedding").alias("dimension"))


add("v06_refresh", _refreshed_vectors, f"with {DELIVERED} select distinct sha256(sha256(text) || chr(0) || 'hashed' || chr(0) || 'signed-words' || chr(0) || '16' || chr(0) || '1') as key, 16 as dimension from delivered where text is not null and ordinal > 0")
registry._SQL["k12_webhook"] = f"with {RUNS}, c as (select status, count(*) as n from runs group by status) select '{{' || string_agg('\"' || status || '\":' || n, ',' order by status) || '}}' as payload from c"


# ---- readers over the tables' own bodies ---------------------------------------------------------------------------


def _pdf_of(body: Column) -> Column:
    """A PDF file (one page, uncompressed) that shows the body's lines, as UTF-16 hex strings."""
    shows = F.array_join(F.transform(F.split(body, "\n"), lambda x: F.concat(F.lit("<FEFF"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj T*"))), "\n")
    head = "%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R 5 0 R] /Count 2>> endobj\n3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R>> endobj\n5 0 obj <</Type /Page /Parent 2 0 R>> endobj\n4 0 obj <<>> stream\nBT /F1 12 Tf 72 700 Td 14 TL\n"
    return F.concat(F.lit(head), shows, F.lit("\nET\nendstream endobj\ntrailer <</Root 1 0 R>>\n%%EOF\n"))


def _read_back(suffix: str, make, what):
    def run(s: SparkSession, d: str) -> DataFrame:
        docs = table(s, d, "canonical_docs").where("body_md is not null").select(F.concat(F.lit("in/"), F.col("canon_id").cast("string"), F.lit(suffix)).alias("relpath"), F.encode(make(F.col("body_md")), "UTF-8").alias("content"))
        return adapters.extract(docs).select("relpath", "engine", "status", what().alias("letters"))

    return run


_LETTERS = lambda: F.sha2(F.regexp_replace(F.regexp_replace("body_md", "(?s)^## Page 1\n\n|\n\n> \\*\\*Note:\\*\\* [^\n]*\n$|^> \\*\\*Note[^\n]*\n$", ""), "[^A-Za-z0-9]", ""), 256)
_FENCED = lambda: F.sha2(F.regexp_replace(F.regexp_replace("body_md", "(?s)^```text\n|\n```\n$", ""), "[^A-Za-z0-9]", ""), 256)
_SAME = "select 'in/' || canon_id || '{0}' as relpath, '{1}' as engine, 'ok' as status, sha256(regexp_replace(body_md, '[^A-Za-z0-9]', '', 'g')) as letters from canonical_docs where body_md is not null"
add("a13_pdf", _read_back(".pdf", _pdf_of, _LETTERS), _SAME.format(".pdf", "pdf"))
add("a16_fallback", _read_back(".rst", lambda c: F.concat(F.lit("."), c), _FENCED), _SAME.format(".rst", "fallback"))
_MAILED = lambda: F.sha2(F.regexp_replace(F.regexp_replace("body_md", "(?s)^.*?\\n## Body\\n+```text\\n|\\n```\\n$", ""), "[^A-Za-z0-9]", ""), 256)
_ALL = lambda: F.sha2(F.regexp_replace("body_md", "[^A-Za-z0-9]", ""), 256)
add("a07_eml_bodies", _read_back(".eml", lambda c: F.concat(F.lit("From: a@x.example\r\nTo: b@y.example\r\nSubject: One\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n."), c), _MAILED), _SAME.format(".eml", "eml"))
add("a03_html_bodies", _read_back(".html", lambda c: F.concat(F.lit("<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><main><p>."), registry._escaped(c), F.lit("</p></main><footer>Imprint</footer></body></html>")), _ALL), _SAME.format(".html", "html"))
add("a02_md_bodies", _read_back(".md", lambda c: F.concat(F.lit("."), c), _ALL), _SAME.format(".md", "md"))
add("a01_txt_bodies", _read_back(".txt", lambda c: F.concat(F.lit("."), c), _FENCED), _SAME.format(".txt", "txt"))


# ---- edges of all methods ----------------------------------------------------------------------------------------

_METHODS_SQL = f"""with {DELIVERED}, {registry.LATEST},
  l as (select id, concept_id as source, unnest(regexp_extract_all(text, '\\[[^\\]]+\\]\\(([^)]+)\\)', 1)) as raw from delivered),
  t as (select id, source, trim(split_part(raw, '#', 1)) as t from l),
  k as (select id, source, case when t like '/%' then ltrim(t, '/') else regexp_extract(source, '^(.*)/[^/]*$', 1) || '/' || t end as target from t where t <> '' and not contains(t, '://')),
  e as (select 'canonical_chunks/v1' as method, 'contains' as kind, id from delivered
    union all select 'canonical_chunks/v1', 'cites', id from delivered where source_sha256 is not null
    union all select 'heading_topic/v1', 'mentions', id from (select id, unnest(heading_path) as label from delivered)
    union all select 'capitalized_entity/v1', 'mentions', id from (select id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}]|[^\\x00-\\x7F\\P{{M}}]', '_', 'g'), '\\b[A-Z][a-z]+(?:{registry.SPACE}+[A-Z][a-z]+)+\\b'))) as label from delivered)
    union all select 'markdown_link/v1', 'mentions', id from k where target <> source and target in (select concept_id from latest))
  select method, kind, count(*) as n, count(distinct id) as n_chunks from e group by all"""
add("r02_edge_methods", lambda s, d: registry._edges(s, d).groupBy("method", "kind").agg(F.count("*").alias("n"), F.countDistinct("evidence").alias("n_chunks")), _METHODS_SQL)

# ---- walks, indexes, reviews, the lint driver ----------------------------------------------------------------------

_ENGINE_ROWS = ", ".join(f"('{e}', {x}, {p})" for e, x, p in registry.ENGINES)


def _walk(s: SparkSession, d: str) -> DataFrame:
    engines = s.createDataFrame(registry.ENGINES, "engine string, extensions array<string>, priority int")
    return outputs.walk_manifest(table(s, d, "canonical_docs").where("source_relpath is not null").select(F.col("source_relpath").alias("relpath")).distinct(), engines)


def _concepts(s: SparkSession, d: str) -> DataFrame:
    return registry.concepts.canonical_concepts(table(s, d, "canonical_docs"))


add("s03_walk_manifest", _walk,
    f"with c as (select engine, unnest(extensions) as ext, priority from (values {_ENGINE_ROWS}) t(engine, extensions, priority)), b as (select ext, arg_min(engine, (priority, engine)) as engine from c group by ext), f as (select distinct source_relpath as relpath, lower(regexp_extract(source_relpath, '(\\.[^./]+)$', 1)) as ext from canonical_docs where source_relpath is not null) select relpath, engine, engine is not null as supported from f left join b using (ext)")
_NAME = "regexp_extract(concept_id, '([^/]+)$', 1)"
add("k06_index_pages", lambda s, d: outputs.index_pages(_concepts(s, d)).select("dir", F.sha2("page", 256).alias("sha"), F.length("page").cast("bigint").alias("n")),
    f"with {registry.LATEST}, r as (select coalesce(nullif(regexp_extract(concept_id, '^(.*)/[^/]*$', 1), ''), '.') as dir, {_NAME} as name, '- [' || {_NAME} || '](' || {_NAME} || ') — ' || coalesce(title, '(untitled)') || ' (' || len(list_filter(string_split(coalesce(body_md, ''), ' '), lambda w: w <> '')) || ' words)' as line from latest), p as (select dir, '# Index' || chr(10) || chr(10) || string_agg(line, chr(10) order by name, line) || chr(10) as page from r group by dir) select dir, sha256(page) as sha, length(page) as n from p")
add("fn09_message_paths", on(lambda t: outputs.message_paths(t.where("source_format = '.pst'")), "canonical_docs"),
    "select canon_id, regexp_replace(regexp_replace(source_relpath, '\\.[^./]+$', ''), '-[0-9]{4}$', '') || '-' || lpad(cast(n as varchar), cast(greatest(4, length(cast(n as varchar))) as int), '0') || '.md' as path from (select *, row_number() over (partition by source_sha256 order by canon_id) as n from canonical_docs where source_format = '.pst' and source_sha256 is not null and source_relpath is not null)")
add("k13_progress", lambda s, d: outputs.progress_events(distinct_runs(table(s, d, "run_results"))).groupBy("run_no", "event").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok")),
    f"with {RUNS}, e as (select distinct run_no, unnest(['start', 'finish']) as event, null as status from runs union all select run_no, 'file', status from runs) select run_no, event, count(*) as n, count(*) filter (where status = 'ok') as n_ok from e group by all")
add("d11_catalog_nodes", lambda s, d: outputs.catalog_nodes(_concepts(s, d)).withColumn("body", F.sha2("body", 256)),
    f"with {registry.LATEST} select concept_id as id, coalesce(okf_type, 'Unknown') as type, coalesce(title, concept_id) as title, case when contains(concept_id, '/') then split_part(concept_id, '/', 1) else '(root)' end as \"group\", greatest(24, least(70, 24 + length(coalesce(body_md, '')) // 200)) as size, okf_status, sha256(substr(coalesce(body_md, ''), 1, 8000)) as body from latest")
add("d11_catalog_links", lambda s, d: registry._doc_links(s, d).select("source", "target", F.when(F.col("exists"), "link").otherwise("unresolved").alias("kind")),
    f"with {registry._LINKS_SQL} select source, target, case when target in (select concept_id from latest) then 'link' else 'unresolved' end as kind from q where source <> target")
add("y07_dry_run", lambda s, d: registry.incremental.reconcile(table(s, d, "sync_records"), registry.incremental.current_files(table(s, d, "canonical_docs"))).groupBy("action").agg(F.count("*").alias("n")),
    f"with r as ({registry._SQL['y06_reconcile']}) select action, count(*) as n from r group by action")


def _decided(s: SparkSession, d: str) -> DataFrame:
    """Decisions from the event log: a purchase approves, an error rejects the document of the user's number."""
    action = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").otherwise("look")
    events = table(s, d, "events").select(F.col("user_id").cast("bigint").alias("canon_id"), action.alias("action"), F.concat(F.lit("r"), (F.col("event_id") % 7).cast("string")).alias("reviewer"), F.col("event_id").alias("at"))
    return registry.review.decide(table(s, d, "canonical_docs"), events)


add("q14_decided", _decided,
    "with e as (select user_id as canon_id, arg_min(event_type, event_id) as t, 'r' || (min(event_id) % 7) as reviewer from events where event_type in ('purchase', 'error') group by user_id) select canon_id, okf_verified as before, case when t = 'purchase' then 'human:' || reviewer else 'human:rejected' end as after, reviewer, case when t = 'purchase' then 'approve' else 'reject' end as action from canonical_docs join e using (canon_id) where okf_verified = 'human:pending'")
_MD = registry._SQL["q02_markdown_lint"]
add("q03_lint_driver", on(lambda t: registry.quality.lint_all(t).groupBy("severity", "rule").agg(F.count("*").alias("n")), "canonical_docs"),
    f"with {registry._LINT_SQL}, m as ({_MD}), p as (select canon_id, list_contains(string_split(coalesce(source_relpath, ''), '/'), 'okf') as c, list_contains(string_split(coalesce(source_relpath, ''), '/'), '_md') as k from canonical_docs), u as (select severity, rule from lint join p using (canon_id) where not k or c union all select 'warning', rule from m join p using (canon_id) where not c) select severity, rule, count(*) as n from u group by all")
_HEADING_LINES = "list_filter(string_split(body_md, chr(10)), lambda x: regexp_matches(x, '^#{1,6}[ \\t]+'))"
add("fn30_headings", on(lambda t: t.where("body_md is not null").select("canon_id", F.array_join(F.transform(F.filter(F.split("body_md", "\n"), lambda x: x.rlike("^#{1,6}[ \\t]+")), lambda x: F.regexp_replace(x, "^#{1,6}[ \\t]+", "")), " / ").alias("headings")), "canonical_docs"),
    f"select canon_id, array_to_string(list_transform({_HEADING_LINES}, lambda x: regexp_replace(x, '^#{{1,6}}[ \\t]+', '')), ' / ') as headings from canonical_docs where body_md is not null")

# ---- SQL twins of queries registered elsewhere -------------------------------------------------------------------

_SUFFIX = "lower(regexp_extract(source_relpath, '(\\.[^./]+)$', 1))"
_BY_SUFFIX = f"case when {_SUFFIX} in ('.html', '.htm') then 'html' when {_SUFFIX} = '.txt' then 'txt' when {_SUFFIX} = '.rtf' then 'rtf' when {_SUFFIX} in ('.docx', '.xlsx', '.pptx') then 'office' when {_SUFFIX} in ('.odt', '.ods', '.odp') then 'odf' when {_SUFFIX} in ('.md', '.markdown') then 'md' when {_SUFFIX} in ('.pdf', '.msg', '.pst', '.eml') then substr({_SUFFIX}, 2) end"
registry._SQL["a17_failures"] = f"with f as (select {_BY_SUFFIX} as engine from canonical_docs where source_relpath is not null) select engine, case when engine in ('html', 'txt', 'rtf', 'md', 'eml') then 'ok' else 'failed' end as status, count(*) as n from f group by all"
registry._SQL["a20_planned_adapters"] = f"with f as (select {_BY_SUFFIX} as engine from canonical_docs where source_relpath is not null) select case when engine in ('pdf', 'office', 'odf') then 'txt' when engine in ('msg', 'pst') then null else engine end as engine, case when engine in ('msg', 'pst') then 'failed' else 'ok' end as status, cast(case when engine in ('pdf', 'office', 'odf') then 2 else 1 end as int) as n_attempts, count(*) as n from f group by all"
registry._SQL["w04_attachment_budget"] = "with recursive w as (select canon_id, attachments, 0 as i, 0::bigint as kept, 0::bigint as total, 0::bigint as skipped from canonical_docs where len(attachments) > 0 union all select canon_id, attachments, i + 1, kept + f, total + case when f = 1 then size else 0 end, skipped + 1 - f from (select *, attachments[i + 1].byte_size as size, case when attachments[i + 1].byte_size <= 800000 and kept < 3 and total + attachments[i + 1].byte_size <= 1500000 then 1 else 0 end as f from w where i < len(attachments))) select canon_id, kept as n_kept, skipped as n_quarantined, total as bytes_kept from w where i = len(attachments)"
registry._SQL["k01_rendered"] = registry._SQL["c01_blocks"].split("select canon_id, case when")[0] + "select canon_id, cast(sum(length(t) + case when regexp_matches(t, '^#{1,6}\\s+[^\\n]+$') then 2 else 0 end) + 2 * (count(*) - 1) as bigint) as n_chars from k group by canon_id"
_RISKY = "regexp_matches({0}, '^[\\s\\x0b\\-?:,\\[\\]{{}}#&*!|>''\"%@`]|: | #|[\\s\\x0b:]$|^(?i:true|false|null|yes|no|on|off|~)$|^[0-9.+-]')"
_YAML = "case when {0} is null then 4 when {0} = '' or " + _RISKY + " then length(replace({0}, chr(39), chr(39) || chr(39))) + 2 else length({0}) end"
_TAGS = "list_filter(string_split(lower(regexp_extract(source_relpath, '^(.*)/[^/]*$', 1)), '/'), lambda x: x <> '') || list_filter([lower(regexp_extract(source_relpath, '\\.([^./]+)$', 1))], lambda x: x <> '')"
_FIELDS = {"type": "okf_type", "title": "title", "status": "okf_status", "generated": "okf_generated", "verified": "okf_verified", "stale_after": "okf_stale_after", "tags": "tagged", "resource": "source_uri", "sha256": "source_sha256"}
registry._SQL["k03_concept_files"] = f"with t as (select *, {CONCEPT} as path, 'tags-' || list_reduce(list_prepend('', list_distinct_ordered), lambda a, b: case when a = '' then b else a || '-' || b end) as tagged from (select *, (select list(tag order by i) from (select tag, min(i) as i from (select unnest({_TAGS}) as tag, generate_subscripts({_TAGS}, 1) as i) group by tag)) as list_distinct_ordered from canonical_docs where source_relpath is not null)) select path, cast({' + '.join(f'{len(k) + 2} + ' + _YAML.format(c) for k, c in _FIELDS.items())} + {4 + len(_FIELDS) - 1 + 6} + length(regexp_replace(coalesce(body_md, ''), '[\\s\\x0b]+$', '')) + 1 as bigint) as n from t"
_MASKED = "regexp_replace(text, '[^\\x00-\\x7F\\P{L}]|[^\\x00-\\x7F\\P{N}]|[^\\x00-\\x7F\\P{M}]', '_', 'g')"
registry._SQL["r01_entities"] = f"with {DELIVERED}, e as (select id, unnest(list_distinct(regexp_extract_all({_MASKED}, '\\b[A-Z][a-z]+(?:{registry.SPACE}+[A-Z][a-z]+)+\\b'))) as label from delivered where text is not null) select 'entity:' || sha256('entity' || chr(0) || lower(trim(regexp_replace(label, '{registry.SPACE}+', ' ', 'g')))) as to_id, count(*) as n from e group by 1"

_SP = registry.SPACE
_SP2 = _SP.replace("{", "{{").replace("}", "}}")
_STRIP = f"regexp_replace(regexp_replace({{0}}, '^{_SP2}+', ''), '{_SP2}+$', '')"
_WRAPPED = f"(not regexp_full_match({{0}}, '{_SP2}*') and not regexp_matches({{0}}, '^{_SP2}*(?:#{{{{1,6}}}}{_SP2}|>{_SP2}|[-*+]{_SP2}|\\p{{{{Nd}}}}+\\.{_SP2}|\\||```)'))"
registry._SQL["t07_wraps"] = f"with d as (select canon_id, string_split(body_md, chr(10)) as ls from canonical_docs where body_md is not null) select canon_id, sha256(array_to_string(list_transform(ls, lambda x, i: case when {_WRAPPED.format('x')} and i > 1 and {_WRAPPED.format('ls[i - 1]')} then ' ' || {_STRIP.format('x')} else case when i = 1 then '' else chr(10) end || case when {_WRAPPED.format('x')} then regexp_replace(x, '{_SP}+$', '') else x end end), '')) as sha from d"
registry._SQL["t12_headings"] = f"with l as (select canon_id, unnest(string_split(body_md, chr(10))) as x, generate_subscripts(string_split(body_md, chr(10)), 1) as i from canonical_docs where body_md is not null), f as (select *, sum(case when starts_with(x, '```') then 1 else 0 end) over (partition by canon_id order by i) as fences from l), h as (select *, length(regexp_extract(x, '^(#{{1,6}}){_SP}', 1)) as len, row_number() over (partition by canon_id order by i) as n from f where fences % 2 = 0 and regexp_matches(x, '^#{{1,6}}{_SP}')), a as (select canon_id, i, len, min(case when n = 1 then 0 else len - n end) over (partition by canon_id order by n) + n as lvl from h), o as (select l.canon_id, l.i, case when lvl is null then x else repeat('#', cast(lvl as bigint)) || substr(x, len + 1) end as x from l left join a on a.canon_id = l.canon_id and a.i = l.i) select canon_id, sha256(string_agg(x, chr(10) order by i)) as sha from o group by canon_id"
registry._SQL["t09_contents"] = f"with d as (select canon_id, body_md, string_split(body_md, chr(10)) as ls from canonical_docs where body_md is not null), n as (select *, list_filter(range(1, len(ls) + 1), lambda i: not regexp_full_match(ls[i], '{_SP}*')) as nb from d), t as (select *, list_transform(nb, lambda i: {_STRIP.format('ls[i]')}) as s from n), p as (select *, nb[1:4] as opening, list_filter(s[1:4], lambda x: not starts_with(x, '#')) as plain, s[5:] as later from t), q as (select *, len(plain) >= 2 and len(opening) >= 2 and len(list_filter(range(1, len(later) - len(plain) + 2), lambda i: later[i:i + len(plain) - 1] = plain)) > 0 as gone from p) select canon_id, sha256(case when gone then array_to_string(list_filter(ls, lambda x, i: not list_contains(opening, i)), chr(10)) else body_md end) as sha from q"

_LEVELS = registry._SQL["h02_merkle_root"].rpartition(" select (select count(*)")[0]
registry._SQL["h03_proofs"] = _LEVELS + ", own as (select path, row_number() over (order by path, leaf) - 1 as idx from leaves), k as (select distinct lvl from lv where n > 1) select path, cast(k.lvl as int) as step, node as sibling, case when lv.idx % 2 = 1 then 'right' else 'left' end as side from own cross join k join lv on lv.lvl = k.lvl and lv.idx = xor(own.idx >> k.lvl, 1)"
registry._SQL["d02_near_duplicates"] = f"with r as (select doc_id, sha256(trim(regexp_replace(lower(text), '{_SP}+', ' ', 'g'))) as class_id, lower(text) as t from documents where text is not null), c as (select class_id, count(*) as n_copies, min(t) as t from r group by 1), w as (select class_id, n_copies, list_filter(string_split_regex(t, '{_SP}+'), lambda x: x <> '') as ws from c), s as (select class_id, unnest(list_distinct(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')))) as h from w where len(ws) > 0), n as (select class_id, count(*) as n from s group by 1), i as (select a.class_id as a, b.class_id as b, count(*) as k from s a join s b on a.h = b.h and a.class_id < b.class_id group by all), l as (select a, b from i join n x on x.class_id = a join n y on y.class_id = b where k / (x.n + y.n - k)::double >= 0.8 - 1e-12), e as (select class_id, count(*) as n_links from (select a as class_id from l union all select b from l) group by 1) select doc_id, class_id, n_copies, coalesce(n_links, 0) as n_links from r join w using (class_id) left join e using (class_id) where len(ws) > 0"


def queries():
    return registry.queries()


def oracle_sql():
    return registry.oracle_sql()
