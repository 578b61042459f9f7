"""Concepts: Markdown bodies of the tables, their blocks, and chunks packed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.text import concept_path, joined_id, token_estimate

MAX_CHARS = 2000


def canonical_concepts(docs: DataFrame) -> DataFrame:
    """concept_id, title, type, status, verified, stale_after, source_sha256, body of the latest conversion of each path."""
    w = Window.partitionBy("concept_id").orderBy(F.desc("converted_at"), F.desc("canon_id"))
    c = docs.select(concept_path(F.col("source_relpath")).alias("concept_id"), "canon_id", "bundle", "title", "body_md", "source_sha256", "source_uri", "source_relpath", "okf_type", "okf_status", "okf_generated", "okf_verified", "okf_stale_after", "converted_at")
    return c.where("source_relpath is not null").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def order_concepts(orders: DataFrame, lineitem: DataFrame, customer: DataFrame) -> DataFrame:
    """One Markdown concept an order: claims, a table and links, from the relational tables."""
    rows = lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" |")).alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    money = F.concat(F.floor(cents / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    body = F.concat(F.lit("# Order "), F.col("o_orderkey").cast("string"), F.lit("\n\nOwner: "), F.col("c_name"), F.lit("\nStatus: "), F.col("o_orderstatus"), F.lit("\n\nDate "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" total $"), money, F.lit("\n\n| line | part | qty |\n| --- | --- | --- |\n"), F.coalesce("rows", F.lit("")), F.lit("\n\nSee [Customer](../customers/"), F.col("o_custkey").cast("string"), F.lit(".md)"))
    joined = orders.join(customer.select("c_custkey", "c_name"), orders.o_custkey == F.col("c_custkey")).join(rows, orders.o_orderkey == F.col("l_orderkey"), "left")
    return joined.select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("concept_id"), F.col("o_orderkey").alias("order_key"), body.alias("body"))


#: the same bodies in SQL, for the oracle
ORDER_CONCEPTS_SQL = """order_concepts as (
  select 'orders/' || o_orderkey || '.md' as concept_id, o_orderkey as order_key,
    '# Order ' || o_orderkey || chr(10) || chr(10) || 'Owner: ' || c_name || chr(10) || 'Status: ' || o_orderstatus || chr(10) || chr(10)
    || 'Date ' || strftime(o_orderdate, '%Y-%m-%d') || ' total $' || (cast(round(o_totalprice * 100) as bigint) // 100) || '.' || lpad(cast(cast(round(o_totalprice * 100) as bigint) % 100 as varchar), 2, '0')
    || chr(10) || chr(10) || '| line | part | qty |' || chr(10) || '| --- | --- | --- |' || chr(10) || coalesce(rows, '') || chr(10) || chr(10) || 'See [Customer](../customers/' || o_custkey || '.md)' as body
  from orders join customer on o_custkey = c_custkey
  left join (select l_orderkey, string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' | ' || cast(l_quantity as bigint) || ' |', chr(10) order by l_linenumber) as rows from lineitem group by l_orderkey) on l_orderkey = o_orderkey)"""


def block_array(body: Column) -> Column:
    """array<struct<ordinal, kind, text>>: the blocks between blank lines."""
    parts = F.filter(F.split(F.regexp_replace(body, "^\\s+|\\s+$", ""), "\\n\\s*\\n"), lambda x: ~x.rlike("^\\s*$"))

    def one(raw: Column, ordinal: Column) -> Column:
        text = F.regexp_replace(raw, "^\\s+|\\s+$", "")
        kind = F.when(text.rlike("^#{1,6}\\s+[^\\n]+$"), "heading").when(F.ltrim(raw).startswith("|"), "table").otherwise("paragraph")
        return F.struct(ordinal.alias("ordinal"), kind.alias("kind"), text.alias("text"))

    return F.transform(parts, one)


def blocks(concepts: DataFrame, body: str = "body", key: str = "concept_id") -> DataFrame:
    """key, ordinal, kind, text: the blocks between blank lines."""
    return concepts.select(key, F.explode(block_array(F.col(body))).alias("b")).select(key, "b.ordinal", "b.kind", "b.text")


def pack(elements: Column, max_chars: int = MAX_CHARS) -> Column:
    """Greedy packing of array<struct<ordinal, kind, text>> into array of chunks; a state machine over the array.

    A heading closes the open chunk and becomes the path of the next; a table closes the chunk it ends; text is added while
    the sum of lengths stays within ``max_chars``.
    """
    chunk = "struct<heading:string, ordinals:array<int>, text:string, size:int>"
    state = f"struct<done:array<{chunk}>, open:{chunk}, heading:string>"
    empty = F.lit(None).cast(chunk)
    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), empty.alias("open"), F.lit(None).cast("string").alias("heading")).cast(state)

    def step(acc: Column, e: Column) -> Column:
        is_heading = e["kind"] == "heading"
        closes = e["kind"].isin("table", "code")
        size = F.length(e["text"])
        full = acc["open"].isNotNull() & (acc["open"]["size"] + size > max_chars)
        flush = acc["open"].isNotNull() & (is_heading | full)
        heading = F.when(is_heading, F.regexp_replace(e["text"], "^#{1,6}\\s+", "")).otherwise(acc["heading"])
        fresh = flush | acc["open"].isNull()
        joined = F.struct(
            F.when(fresh, heading).otherwise(acc["open"]["heading"]).alias("heading"),
            F.when(fresh, F.array(e["ordinal"])).otherwise(F.concat(acc["open"]["ordinals"], F.array(e["ordinal"]))).alias("ordinals"),
            F.when(fresh, e["text"]).otherwise(F.concat(acc["open"]["text"], F.lit("\n\n"), e["text"])).alias("text"),
            F.when(fresh, size).otherwise(acc["open"]["size"] + size).alias("size"),
        ).cast(chunk)
        done = F.when(flush, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        done = F.when(closes, F.concat(done, F.array(joined))).otherwise(done)
        return F.struct(done.alias("done"), F.when(closes, empty).otherwise(joined).alias("open"), heading.alias("heading")).cast(state)

    return F.aggregate(elements, start, step, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def chunks_of(concepts: DataFrame, body: str = "body", key: str = "concept_id", max_chars: int = MAX_CHARS) -> DataFrame:
    """key, ordinal, heading, text, token_estimate, oversize, chunk_id."""
    # the blocks stay an array of their row: nothing is shuffled, and a key given twice stays two documents
    packed = concepts.select(key, pack(block_array(F.col(body)), max_chars).alias("chunks"))
    c = packed.select(key, F.posexplode("chunks").alias("ordinal", "c"))
    ident = joined_id(F.col(key).cast("string"), F.array_join(F.col("c.ordinals").cast("array<string>"), ","), F.col("ordinal").cast("string"), F.lit("1"))
    return c.select(key, "ordinal", F.col("c.heading").alias("heading"), F.col("c.text").alias("text"), token_estimate(F.col("c.text")).alias("token_estimate"), (F.col("c.size") > max_chars).alias("oversize"), ident.alias("chunk_id"))


def delivered(chunks: DataFrame) -> DataFrame:
    """Chunks delivered more than once, once: the latest indexed."""
    w = Window.partitionBy("id").orderBy(F.desc("indexed_at"), F.desc("ordinal"))
    return chunks.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def citations(chunks: DataFrame) -> DataFrame:
    """Per source: the union of its chunks' places."""
    return delivered(chunks).groupBy("source_sha256").agg(F.min("citation.page").alias("first_page"), F.min("citation.start_char").alias("start_char"), F.max("citation.end_char").alias("end_char"), F.count("*").alias("n_chunks"))
