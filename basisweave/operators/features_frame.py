"""Model frames fitted on training rows: prune, clip, standardise; advisory flags on diagnostics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisweave.functions.exprs import corr, sample_kurtosis, sample_skew


def fitted_frame(rows: DataFrame, train: Column, features: Iterable[str], target: str, max_null: float = 0.4, min_corr: float = 0.005, tails: tuple[float, float] = (0.01, 0.99)) -> tuple[DataFrame, list[str]]:
    """``rows`` with the features that stay clipped to the training rows' tails and standardised by them, and their names.

    A feature goes if too many of its training values are null or it hardly correlates with the target. Two aggregates give
    all columns' statistics at once: a number a column and statistic reaches the driver."""
    features, own = list(features), rows.where(train)
    first = own.agg(*(c.alias(f"{n}{k}") for k, f in enumerate(features) for n, c in (("u", F.avg(F.col(f).isNull().cast("int"))), ("c", F.abs(F.coalesce(corr(f, target), F.lit(0.0)))), ("q", F.expr(f"percentile(`{f}`, array({tails[0]}, {tails[1]}))"))))).first()
    stays = [k for k, _ in enumerate(features) if first[f"u{k}"] is not None and first[f"u{k}"] <= max_null and first[f"c{k}"] >= min_corr and first[f"q{k}"]]
    if not stays:
        return rows.drop(*features), []
    clipped = {k: F.when(F.col(features[k]).isNotNull(), F.greatest(F.lit(first[f"q{k}"][0]), F.least(F.lit(first[f"q{k}"][1]), F.col(features[k])))) for k in stays}
    second = own.agg(*(c.alias(f"{n}{k}") for k, v in clipped.items() for n, c in (("m", F.avg(v)), ("s", F.stddev_samp(v))))).first()
    scaled = {features[k]: (v - F.lit(second[f"m{k}"])) / F.nullif(F.lit(second[f"s{k}"]), F.lit(0.0)) for k, v in clipped.items()}
    rest = [c for c in rows.columns if c not in features]
    return rows.select(*rest, *(v.alias(n) for n, v in scaled.items())), list(scaled)


def advice(feature: Column, value: Column, target: Column, max_null: float = 0.5, weak: float = 0.01, skew: float = 2.0, kurtosis: float = 10.0) -> list[Column]:
    """Aggregates: too_sparse and weak of ``feature``, take_log and winsorise of ``value`` by its bias-corrected moments."""
    return [
        (F.avg(feature.isNull().cast("int")) > max_null).alias("too_sparse"),
        (F.abs(F.round(corr(feature, target), 4)) < weak).alias("weak"),
        (F.abs(F.round(sample_skew(value), 6)) > skew).alias("take_log"),
        (F.round(sample_kurtosis(value), 6) > kurtosis).alias("winsorise"),
    ]
