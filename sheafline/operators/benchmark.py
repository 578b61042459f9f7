"""Quality benchmarks: anchor recall, heading order, deltas to a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchor_recall(text: Column, anchors: Column) -> Column:
    """Share of the anchors the text contains; 1 where none is expected."""
    found = F.size(F.filter(anchors, lambda a: F.contains(text, a)))
    return F.when(F.size(anchors) <= 0, 1.0).otherwise(found / F.size(anchors))


def heading_order(body: Column, expected: Column) -> Column:
    """Are the expected headings the first of the body, in order?"""
    heads = F.transform(F.filter(F.split(body, "\n"), lambda x: x.rlike("^#{1,6} ")), lambda x: F.trim(F.regexp_replace(x, "^#+ ", "")))
    return F.slice(heads, F.lit(1), F.greatest(F.lit(1), F.size(expected))) == expected


def deltas(current: DataFrame, baseline: DataFrame, key: str, metrics: tuple[str, ...]) -> DataFrame:
    """key, metric, delta (six digits) for every fixture both have."""
    b = baseline.select(key, *[F.col(m).alias(f"b_{m}") for m in metrics])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m) - F.col(f"b_{m}"), 6).alias("delta")) for m in metrics])
    return current.join(b, key).select(key, F.explode(rows).alias("r")).select(key, "r.metric", "r.delta")


def unknown_fixtures(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Fixtures without a baseline: an error of the run."""
    return current.select(key).join(baseline.select(key), key, "left_anti")


def confidence(nonempty: Column, attempted: Column, anchors_ok: Column, structured: Column, ocr_warning: Column) -> Column:
    """0.4 for text, 0.3 for the engine (0.1 less under an OCR warning), 0.2 for anchors, 0.1 for structure."""
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    return F.round(one(nonempty, 0.4) + one(attempted, 0.3) - one(attempted & ocr_warning, 0.1) + one(anchors_ok, 0.2) + one(structured, 0.1), 6)
