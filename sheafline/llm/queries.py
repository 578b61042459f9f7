"""Queries of the training-data operators; each runs over its whole tables with the operators' defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheafline.llm import encoding, harm, leak, mail, mix, page, pii, scan
from sheafline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def docs(f: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda s, d: f(table(s, d, "canonical_docs"))

    def with_chunks(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        return lambda s, d: f(table(s, d, "canonical_docs"), table(s, d, "chunks"))

    def corpus(f: Callable[[DataFrame, DataFrame], DataFrame], other: str) -> Query:
        return lambda s, d: f(table(s, d, "documents"), table(s, d, other))

    return {
        "p1_found": docs(encoding.found),
        "p1_repaired": docs(encoding.repaired),
        "p1_chains": docs(encoding.chain_report),
        "p2_found": docs(mail.removed_lines),
        "p2_new_text": docs(mail.new_text),
        "p3_found": docs(page.furniture_lines),
        "p3_main_text": docs(page.main_text),
        "p3_hosts": docs(page.host_report),
        "p4_found": docs(scan.noise_lines),
        "p4_readable": docs(scan.readable_text),
        "p5_found": with_chunks(pii.found),
        "p5_redacted": with_chunks(pii.redacted),
        "p5_kinds": with_chunks(pii.kind_report),
        "p6_found": corpus(leak.leaked_pairs, "eval_items"),
        "p6_spans": corpus(leak.removal_spans, "eval_items"),
        "p6_items": corpus(leak.leak_report, "eval_items"),
        "p7_found": corpus(mix.short_sources, "mix_targets"),
        "p7_mixture": corpus(mix.mixture, "mix_targets"),
        "p7_shares": corpus(mix.reached, "mix_targets"),
        "p8_found": corpus(harm.found, "review_labels"),
        "p8_scores": corpus(harm.scores, "review_labels"),
        "p8_rates": corpus(harm.source_rates, "review_labels"),
    }


def oracle_sql() -> dict[str, str]:
    """None of the operators can be stated in SQL; tests hold them against brute force and planted cases."""
    return {}
