"""Selecting rare regions: an exact percentile of a feature, and the rows at or above it."""

from __future__ import annotations

from math import isnan

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Ranks to each side of the wanted one, as a share of what is left, that a sketch must leave in.
MARGIN = 0.002
#: Values left, from which on they are counted one by one.
FEW = 10_000


def percentile_threshold(features: DataFrame, feature: str = "area", percentile: float = 99) -> DataFrame:
    """One row: threshold, the exact percentile (0 to 100, linear between ranks) of the feature; null without rows, NaN with any NaN."""
    found = exact_percentile(written(features.select(f"`{feature}`")), feature, percentile)
    return features.sparkSession.range(1).select(F.lit(found).cast("double").alias("threshold"))


def exact_percentile(features: DataFrame, feature: str, percentile: float, few: int = FEW) -> float | None:
    """The same as a number; no task and not the driver ever holds all distinct values."""
    return exact_percentiles(features, {feature: percentile}, few)[feature]


def exact_percentiles(features: DataFrame, percentiles: dict[str, float], few: int = FEW) -> dict[str, float | None]:
    """Exact percentiles of several features. One pass finds counts and ends of all; up to ``few`` rows, one more finds all percentiles."""
    values = {f: F.col(f"`{f}`").cast("double") for f in percentiles}
    made = [x.alias(f"{k}{i}") for i, v in enumerate(values.values()) for k, x in (("n", F.count(v)), ("nan", F.count_if(F.isnan(v))), ("low", F.min(v)), ("high", F.max(v)))]
    facts = features.agg(*made).first().asDict()
    facts = {f: {k: facts[f"{k}{i}"] for k in ("n", "nan", "low", "high")} for i, f in enumerate(values)}
    found = {f: float("nan") if x["nan"] else None for f, x in facts.items()}
    rest = [f for f, x in facts.items() if x["n"] and not x["nan"]]
    if rest and max(facts[f]["n"] for f in rest) <= few:
        return found | dict(zip(
            rest, features.agg(*[F.percentile(values[f], F.lit(percentiles[f] / 100)) for f in rest]).first(), strict=True,
        ))
    return found | {f: _percentile(features, f, percentiles[f], facts[f], few) for f in rest}


def _percentile(features: DataFrame, feature: str, percentile: float, facts: dict, few: int) -> float:
    """By rounds: a mergeable quantile sketch of the values left brackets the wanted ranks, and one pass counts the values under and inside the bracket.

    A bracket that holds the ranks replaces the one before (a few thousandths of it), another is widened. Of the ``few`` values that are
    left, distinct ones are counted and read in order, as a stream, up to the wanted ranks. The features are read two or three
    times a round and should be a written table.
    """
    v = features.select(F.col(f"`{feature}`").cast("double").alias("v")).filter("v IS NOT NULL")
    left, low, high = facts["n"], facts["low"], facts["high"]
    rank = percentile / 100 * (left - 1)
    wanted = [int(rank), min(int(rank) + (rank > int(rank)), left - 1)]
    below, margin = 0, MARGIN
    while left > few and low < high and margin < 1:
        inside = v.filter(F.col("v").between(low, high))
        shares = [max(0.0, (wanted[0] - below) / left - margin), min(1.0, (wanted[1] + 1 - below) / left + margin)]
        a, b = inside.agg(F.percentile_approx("v", shares, 10_000).alias("e")).first()["e"]
        under, held = inside.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b))).first()
        if not below + under <= wanted[0] <= wanted[1] < below + under + held:
            margin *= 4
        elif held == left:
            break  # one value or few hold nearly all ranks
        else:
            low, high, below, left = a, b, below + under, held
    counted = v.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v")
    found: list[float] = []
    for value, n in counted.toLocalIterator():
        below += n
        found += [value] * sum(r < below for r in wanted[len(found) :])
        if len(found) == 2:
            break
    return found[0] + (found[1] - found[0]) * (rank - wanted[0])


def at_or_above(features: DataFrame, feature: str, threshold: float | None) -> DataFrame:
    """Rows whose feature is at least the threshold. NaN is never selected, and without a threshold nothing is."""
    if threshold is None or isnan(threshold):
        return features.filter(F.lit(False))
    v = F.col(f"`{feature}`")
    return features.filter((v >= threshold) & ~F.isnan(v.cast("double")))


def select_rare(features: DataFrame, feature: str = "area", percentile: float = 99) -> DataFrame:
    """The rare rows with their threshold. The features are written once, as the percentile and the selection read them; an unknown feature fails at once."""
    features.select(f"`{feature}`")
    features = written(features)
    threshold = exact_percentile(features, feature, percentile)
    return at_or_above(features, feature, threshold).withColumn("threshold", F.lit(threshold).cast("double"))


def count_labels(labelled: DataFrame) -> DataFrame:
    """One row: the largest label (the number of regions where labels are consecutive), 0 without any."""
    return labelled.agg(F.coalesce(F.max("label"), F.lit(0)).cast("long").alias("n_cells"))


def look_up(features: DataFrame, labels: DataFrame) -> DataFrame:
    """The features of given labels; Spark chooses the join by size."""
    return features.join(labels.select("label").distinct(), "label", "left_semi")
