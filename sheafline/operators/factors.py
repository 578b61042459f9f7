"""The review queue's factors: a registry with an allow-list, and weights a pack may override."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.operators.quality import SECRET

#: the factors a queue may have, with their weights (fixed values)
WEIGHTS = {"diagnostic_severity": 1.0, "ocr_fallback_state": 1.0, "sensitivity_findings": 1.0, "policy_errors": 1.0, "stale_state": 1.0, "age": 0.5}


@dataclass(frozen=True)
class Factor:
    name: str
    value: Callable[[str], Column]  # of the date of today
    weight: float


def _pending(now: str) -> Column:
    return F.when(F.col("okf_verified") == "human:pending", 1.0).otherwise(0.0)


def _ocr(now: str) -> Column:
    return F.when(F.element_at("metadata", "ocr_enabled") == "true", 1.0).otherwise(0.0)


def _sensitive(now: str) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all("body_md", F.lit("(" + SECRET + ")"), F.lit(1))), F.lit(0)).cast("double")


def _policy(now: str) -> Column:
    return F.when(F.coalesce(F.col("source_uri"), F.lit("")) == "", 1.0).when(F.coalesce(F.col("okf_type"), F.lit("")) == "", 1.0).otherwise(0.0)


def _stale(now: str) -> Column:
    return F.when(F.col("okf_stale_after") < now, 1.0).otherwise(0.0)


def _age(now: str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.datediff(F.to_date(F.lit(now)), F.to_date("converted_at")) / 365.0))


class Registry:
    """The factors of a queue; only names of the allow-list are taken."""

    def __init__(self) -> None:
        values = {"diagnostic_severity": _pending, "ocr_fallback_state": _ocr, "sensitivity_findings": _sensitive, "policy_errors": _policy, "stale_state": _stale, "age": _age}
        self.factors = {n: Factor(n, f, WEIGHTS[n]) for n, f in values.items()}

    def register(self, name: str, value: Callable[[str], Column], weight: float = 1.0) -> Factor:
        if name not in WEIGHTS:
            raise ValueError(f"{name} is none of {sorted(WEIGHTS)}")
        self.factors[name] = Factor(name, value, weight)
        return self.factors[name]

    def contributions(self, docs: DataFrame, now: str, weights: dict[str, float] | None = None) -> DataFrame:
        """canon_id, source_sha256, factor, value, weight, contribution: one row a document and factor."""
        for name in weights or {}:
            if name not in WEIGHTS:
                raise ValueError(f"a weight for the unknown factor {name}")
        rows = []
        for name, f in self.factors.items():
            weight = float((weights or {}).get(name, f.weight))
            value = F.coalesce(f.value(now), F.lit(0.0)).cast("double")
            rows.append(F.struct(F.lit(name).alias("factor"), value.alias("value"), F.lit(weight).alias("weight"), F.round(value * weight, 9).alias("contribution")))
        return docs.select("canon_id", "source_sha256", F.explode(F.array(*rows)).alias("f")).select("canon_id", "source_sha256", "f.*")

    def queue(self, docs: DataFrame, now: str, weights: dict[str, float] | None = None) -> DataFrame:
        """canon_id, source_sha256, priority: the sum of the contributions, without a shuffle."""
        for name in weights or {}:
            if name not in WEIGHTS:
                raise ValueError(f"a weight for the unknown factor {name}")
        parts = [F.round(F.coalesce(f.value(now), F.lit(0.0)).cast("double") * float((weights or {}).get(n, f.weight)), 9) for n, f in self.factors.items()]
        return docs.select("canon_id", "source_sha256", F.round(sum(parts, F.lit(0.0)), 9).alias("priority"))
