"""The library's front door: one object over a directory of tables, every answer a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions.snippet import snippets
from sheafline.operators import concepts, graph, incremental, index_store, quality, search
from sheafline.plans import minisql
from sheafline.session import table


class UnknownConcept(LookupError):
    """No concept has this id, title or suffix."""


class Engine:
    """Search, read, traverse, check and compare a bundle."""

    def __init__(self, spark: SparkSession, sf_dir: str, index: str | None = None):
        """``index``: folder of a stored search index; searches then read its postings and no texts but those of the hits."""
        self.spark, self.sf_dir, self.index = spark, sf_dir, index

    def build_index(self, folder: str) -> None:
        """Writes the search index of all chunks below a shared folder and uses it from then on."""
        index_store.write(self.chunks().where("concept_id is not null"), folder)
        self.index = folder

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def concepts(self) -> DataFrame:
        return concepts.canonical_concepts(self._table("canonical_docs"))

    def chunks(self) -> DataFrame:
        return concepts.delivered(self._table("chunks"))

    def links(self) -> DataFrame:
        return graph.concept_links(self.concepts(), "body_md")

    def edges(self) -> DataFrame:
        return graph.build_edges(self.chunks(), self.concepts().select("concept_id"))

    def list_bundles(self) -> DataFrame:
        return self._table("bundle_registry").join(self.concepts().groupBy(F.col("bundle").alias("slug")).agg(F.count("*").alias("n_concepts")), "slug", "left").na.fill(0, ["n_concepts"])

    def search(self, query: str, limit: int = 20, bundle: str | None = None) -> DataFrame:
        """id, concept_id, ordinal, score, snippet of the best chunks."""
        found = self.chunks()
        if bundle:
            found = found.join(self.concepts().where(F.col("bundle") == bundle).select("concept_id"), "concept_id", "left_semi")
        if self.index and query.strip():
            ranked = index_store.Index(self.spark, self.index).ranked(query)
            hits = (ranked.join(found.select("id"), "id", "left_semi") if bundle else ranked).orderBy("score", "concept_id", "ordinal").limit(limit)
        else:
            hits = search.search(found, query, limit)
        words = [w for w in search._plain(query) if w not in ("and", "or", "not", "near")]
        return hits.join(found.select("id", "text"), "id").select("id", "concept_id", "ordinal", "score", snippets(F.col("text"), words).alias("snippet")).orderBy("score", "concept_id", "ordinal")

    def find(self, text: str, limit: int = 50) -> DataFrame:
        return search.substring_hits(self.concepts(), text, ("concept_id", "title", "body_md")).select("concept_id", "title").orderBy("concept_id").limit(limit)

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        return self.concepts().select("concept_id", "title", "okf_type", "okf_status").orderBy("concept_id").offset((max(1, number) - 1) * size).limit(size)

    def resolve(self, name: str) -> str:
        """A concept's id by id, else by title, else by the end of its path; several candidates are an error naming them."""
        low = name.lower()
        rank = F.when(F.col("concept_id") == name, 0).when(F.lower("title") == low, 1).when(F.col("concept_id").endswith(name) | F.col("concept_id").endswith(name + ".md"), 2)
        rows = self.concepts().select("concept_id", rank.alias("rank")).where("rank is not null").orderBy("rank", "concept_id").limit(20).collect()
        best = [r.concept_id for r in rows if r.rank == rows[0].rank]
        if not best:
            raise UnknownConcept(name)
        if len(best) > 1:
            raise UnknownConcept(f"{name} may be {', '.join(best)}")
        return best[0]

    def get_concept(self, name: str) -> DataFrame:
        return self.concepts().where(F.col("concept_id") == self.resolve(name))

    def context(self, name: str, depth: int = 1, max_tokens: int = 4000) -> DataFrame:
        """concept_id, level, body (500 characters) of the surroundings, by level and id, within a budget of characters."""
        start = self.spark.createDataFrame([("concept:" + self.resolve(name),)], "id string")
        both = self.links().where("exists").select(F.concat(F.lit("concept:"), "source").alias("from_id"), F.concat(F.lit("concept:"), "target").alias("to_id"))
        near = graph.reachable(both, start, min(5, max(0, depth)), both_ways=True)
        pages = near.select(F.expr("substring(id, 9)").alias("concept_id"), "level").join(self.concepts().select("concept_id", F.substring("body_md", 1, 500).alias("body")), "concept_id")
        return pages.orderBy("level", "concept_id").limit(max(1, max_tokens * 4 // 500))

    def related(self, name: str, limit: int = 10) -> DataFrame:
        return graph.related(self.edges(), "concept:" + self.resolve(name), limit)

    def impact(self, name: str) -> DataFrame:
        return graph.impact(self.edges(), self.spark.createDataFrame([("concept:" + self.resolve(name),)], "id string"), returning=True)

    def doctor(self) -> DataFrame:
        total = self.concepts().agg(F.count("*").alias("total"))
        return quality.health(total, self.links().where("not exists").agg(F.count("*").alias("errors")))

    def diff(self, other: Engine) -> DataFrame:
        """concept_id, change between this bundle and another state of it."""
        own = lambda e: e.concepts().select("concept_id", F.sha2(F.coalesce("body_md", F.lit("")), 256).alias("digest"))
        return incremental.snapshot_diff(own(self), own(other), "concept_id", "digest")

    def sql(self, statement: str) -> DataFrame:
        c = self.concepts().select("concept_id", "title", F.col("okf_type").alias("type"), F.col("okf_status").alias("status"), "bundle")
        return minisql.run(statement, {"concepts": c, "links": self.links().select("source", "target")})


def main(argv: list[str] | None = None) -> None:
    """python -m sheafline.plans.engine DIR search|find|page|related|impact|doctor|bundles|sql [ARG]"""
    import sys

    from sheafline.session import build_session, ship

    args = sys.argv[1:] if argv is None else argv
    if len(args) < 2:
        raise SystemExit(main.__doc__)
    spark = build_session()
    ship(spark)
    e = Engine(spark, args[0])
    arg = args[2] if len(args) > 2 else ""
    what = {"search": lambda: e.search(arg), "find": lambda: e.find(arg), "page": lambda: e.page(int(arg or 1)), "related": lambda: e.related(arg), "impact": lambda: e.impact(arg), "doctor": e.doctor, "bundles": e.list_bundles, "sql": lambda: e.sql(arg)}
    if args[1] not in what:
        raise SystemExit(main.__doc__)
    what[args[1]]().show(50, truncate=80)


if __name__ == "__main__":
    main()
