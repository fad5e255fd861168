"""Scanning: labels from scores, recovery of shifted scores, risk, confidence, threats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import order_statistics, quantiles

BANDS = ((-0.4, "critical"), (-0.2, "high"), (-0.1, "medium"))


def risk_level(percent: Column, cuts: tuple[float, float, float] = (15.0, 40.0, 75.0)) -> Column:
    """LOW, MEDIUM, HIGH or CRITICAL; the recommendation block has cuts of 10, 25 and 40."""
    return F.when(percent < cuts[0], "LOW").when(percent < cuts[1], "MEDIUM").when(percent < cuts[2], "HIGH").otherwise("CRITICAL")


def supervised_labels(df: DataFrame, probabilities: str, classes: list[str], benign: int | None, sensitivity: float) -> DataFrame:
    """df with attack_prob and prediction: the likeliest class but benign if attacks are likely enough, else benign."""
    p = F.col(probabilities)
    names = F.array(*map(F.lit, classes))
    if benign is None:
        best = F.array_position(p, F.array_max(p)) - 1
        return df.withColumn("attack_prob", F.array_max(p)).withColumn("prediction", F.get(names, best.cast("int")))
    attack = 1 - F.get(p, F.lit(benign))
    others = F.transform(p, lambda x, i: F.when(i == benign, -1.0).otherwise(x))
    best = F.get(names, (F.array_position(others, F.array_max(others)) - 1).cast("int"))
    return df.withColumn("attack_prob", attack).withColumn("prediction", F.when(attack >= sensitivity, best).otherwise(classes[benign]))


def anomaly_cut(df: DataFrame, score: str, sensitivity: float, model_threshold: float | None = None, band: float = 0.0) -> DataFrame:
    """One row with the threshold: the model's, else the 2 percent quantile, moved by how far sensitivity is from 0.30."""
    base = F.lit(model_threshold if model_threshold is not None else (quantiles(df, score, [0.02]) or [0.0])[0])
    scale = F.greatest(F.stddev_pop(score), F.lit(0.15 * band), F.lit(1e-6))
    return df.agg((base + (0.30 - sensitivity) * 2 * scale).alias("threshold"))


def anomaly_labels(df: DataFrame, score: str, cut: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(cut)).withColumn("is_alert", F.col(score) < F.col("threshold"))


def lowest(df: DataFrame, score: str, key: list[str], share: float) -> DataFrame:
    """df with is_alert: exactly ceil(share * n) rows of least score, ties by key.

    The cut is found on counts of scores, in ranges of them; only rows that tie with it are ordered.
    """
    n = df.count()
    k = math.ceil(share * n)
    if not n or k <= 0:
        return df.withColumn("is_alert", F.lit(False))
    at = order_statistics(df, score, [k - 1])[k - 1]
    below = df.filter(F.col(score) < at).count()
    tied = df.filter(F.col(score) == at).orderBy(*key).limit(k - below).select(*key, F.lit(True).alias("_t"))
    return df.join(tied, key, "left").withColumn("is_alert", (F.col(score) < at) | F.coalesce("_t", F.lit(False))).drop("_t")


def band() -> Column:
    """The width of a model's calibration scores from the quantiles that its manifest has: q95 - q05, else q99 - q01, else 6 std."""
    return F.coalesce(F.col("q95") - F.col("q05"), F.col("q99") - F.col("q01"), F.col("std") * 6, F.lit(0.0))


RELAXED = ("supervised_fp_relaxed_for_recall", "supervised_fp_bound")


def recovery(stats: DataFrame) -> DataFrame:
    """stats with recovery_share and recovery_policy: whether, and how many of, the lowest scores are to be marked all the same.

    A row of stats is a scan: n, found, score_min, threshold, scale, and of its model's calibration fp_cap, attack_support and
    policy, with input_type and dataset_type.  A scan that found nothing, with all scores far above the threshold, marks the
    share of the calibration's cap, and more for a wider gap.  A scan of flows in CSV that found few, by a model calibrated
    on attacks, marks a floor of 12 to 18 percent.
    """
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    cap, support, policy = F.coalesce("fp_cap", F.lit(0.0)), F.coalesce("attack_support", F.lit(0)), F.coalesce("policy", F.lit(""))
    gap = F.col("score_min") - F.col("threshold")
    allowed = (cap > 0) & (F.col("n") >= 20) & ((support <= 0) | policy.startswith("unsupervised") | policy.isin(*RELAXED))
    shifted = F.coalesce((F.col("found") == 0) & (gap > F.greatest(0.5 * F.col("scale"), F.lit(0.02))) & allowed, F.lit(False))
    ratio = gap / F.greatest(F.col("scale"), F.lit(1e-6))
    bonus = F.when(ratio >= 2.2, 0.12).when(ratio >= 1.6, 0.08).when(ratio >= 1.2, 0.05).otherwise(0.0)
    share = clip(clip(cap, 0.03, 0.20) + bonus, 0.03, 0.20)
    rate = F.when(shifted, F.ceil(share * F.col("n")) / F.col("n")).otherwise(F.col("found") / F.col("n"))
    floor = clip(cap + 0.04, 0.12, 0.18)
    flows = (F.col("input_type") == "csv") & (F.col("dataset_type") == "CIC-IDS") & (F.col("n") >= 500)
    low = F.coalesce(flows & (support > 0) & (cap > 0) & policy.isin(*RELAXED) & (rate < 0.08) & (floor > rate + 1e-9), F.lit(False))
    return stats.withColumn("recovery_share", F.when(low, floor).when(shifted, share).otherwise(0.0)).withColumn("recovery_policy", F.when(low, "if_threshold_csv_low_rate_recovery").when(shifted, "if_threshold_shift_recovery").otherwise("if_threshold"))


def recovered(df: DataFrame, score: str, key: list[str], cut: float, scale: float, calibration: dict) -> DataFrame:
    """df with is_alert: scores under the cut, or where recovery() asks for it the lowest share of them."""
    row = df.agg(F.count("*").alias("n"), F.count_if(F.col(score) < cut).alias("found"), F.min(score).alias("score_min"))
    given = {"threshold": cut, "scale": scale, "fp_cap": None, "attack_support": None, "policy": None, "input_type": "csv", "dataset_type": "CIC-IDS"} | calibration
    kinds = {"threshold": "double", "scale": "double", "fp_cap": "double", "attack_support": "int"}
    share = recovery(row.withColumns({k: F.lit(v).cast(kinds.get(k, "string")) for k, v in given.items()})).first()["recovery_share"]  # one row
    return lowest(df, score, key, share) if share > 0 else df.withColumn("is_alert", F.col(score) < cut)


def summary(df: DataFrame, alert: str) -> DataFrame:
    """Rows, alerts and risk in percent with its level."""
    s = df.agg(F.count("*").alias("total"), F.count_if(alert).alias("anomalies"))
    risk = F.when(F.col("total") > 0, F.round(F.col("anomalies") * 100 / F.col("total"), 2)).otherwise(0.0)
    return s.withColumn("risk_score", risk).withColumn("risk_level", risk_level(F.col("risk_score")))


def confidence(df: DataFrame, value: str, to: str = "confidence") -> DataFrame:
    """Values from 0 to 1 by least and greatest finite one; a constant is only clipped, what is no number is 0."""
    x = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    span = F.when(F.col("_hi") > F.col("_lo"), (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return df.crossJoin(F.broadcast(ends)).withColumn(to, F.coalesce(span, F.lit(0.0))).drop("_lo", "_hi")


def anomaly_score(decision: Column) -> Column:
    return F.greatest(-decision, F.lit(0.0))


def anomaly_severity(score: Column) -> Column:
    out = F
    for cut, name in BANDS:
        out = out.when(score < cut, name)
    return out.otherwise("low")


def outcome(actual: Column, predicted: Column, benign: str = "Normal") -> Column:
    """OK, FP (benign taken for an attack), FN (the reverse) or other (one attack for another)."""
    return F.when(actual == predicted, "OK").when(actual == benign, "FP").when(predicted == benign, "FN").otherwise("other")


def distribution(df: DataFrame, prediction: str) -> DataFrame:
    return df.groupBy(prediction).agg(F.count("*").alias("count")).orderBy(F.desc("count"), prediction)


def effective_sensitivity(recommended: Column, manual: Column) -> Column:
    """The sensitivity chosen by hand, else the recommended one, from 0.01 to 0.99."""
    return F.least(F.greatest(F.coalesce(manual, recommended), F.lit(0.01)), F.lit(0.99))


def tradeoff(sensitivity: Column) -> Column:
    """What a sensitivity means: very_high up to 0.20, high up to 0.40, balanced up to 0.70, else conservative."""
    s = F.least(F.greatest(sensitivity, F.lit(0.01)), F.lit(0.99))
    return F.when(s <= 0.20, "very_high").when(s <= 0.40, "high").when(s <= 0.70, "balanced").otherwise("conservative")


def preview(df: DataFrame, actual: str, predicted: str, key: list[str], n: int = 200) -> DataFrame:
    """n rows at most, errors first, in the order of the key."""
    return df.orderBy(F.desc(F.col(actual) != F.col(predicted)), *key).limit(n)


def outcomes(df: DataFrame, actual: str, predicted: str, probability: str, keep: tuple[str, ...] = (), benign: str = "Normal") -> DataFrame:
    """df with each row's outcome, of some outcomes only if asked, the greatest probability first and missing ones last."""
    d = df.withColumn("outcome", outcome(F.col(actual), F.col(predicted), benign))
    return (d.filter(F.col("outcome").isin(*keep)) if keep else d).orderBy(F.desc_nulls_last(probability))


CONTEXT = ("timestamp", "time", "src_ip", "dst_ip", "src_port", "dst_port", "destination_port", "protocol")


def result_view(df: DataFrame, target: str = "target_label") -> DataFrame:
    """A scan's context columns, else its first six; destination_port as dst_port if there is none, and the target."""
    have = [c for c in CONTEXT if c in df.columns] or [c for c in df.columns if c != target][:6]
    out = df.select(*have, *([target] if target in df.columns and target not in have else []))
    return out.withColumnRenamed("destination_port", "dst_port") if "destination_port" in have and "dst_port" not in have else out


DETAILS = ("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "protocol_type", "proto", "service", "flag", "state", "attack_name", "detection_reason", "confidence", "severity", "recommendation")


def detail_view(df: DataFrame) -> DataFrame:
    """The columns of details that say something, and those that are always shown."""
    from .labels import informative

    have = [c for c in DETAILS if c in df.columns]
    says = {r["column"] for r in informative(df, have).filter("informative").collect()} if have else set()  # a row a column
    return df.select(*(c for c in have if c in says or c in ("attack_name", "severity", "confidence")))
