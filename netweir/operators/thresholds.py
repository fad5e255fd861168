"""Thresholds: curves in one pass, calibration, and the rules that resolve a threshold at scan time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import by_group, quantiles

POLICY, LEGACY = "netweir.thresholds.v1", "netweir.thresholds.legacy.v0"
GRID = [0.01 + i * 0.01 for i in range(99)]
DEFAULT = 0.30


def clamped(c: Column, lo: float = 0.01, hi: float = 0.99) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def bucket(score: Column, grid: list[float]) -> Column:
    """How many grid values a score reaches; compares the same doubles as score >= threshold does."""
    guess = F.greatest(F.least(F.floor(score * len(grid)).cast("int"), F.lit(len(grid))), F.lit(0))
    g = F.array(*map(F.lit, grid))
    near = F.sequence(F.greatest(guess - 2, F.lit(0)), F.least(guess + 2, F.lit(len(grid) - 1)))
    below = F.greatest(guess - 2, F.lit(0))
    return below + F.size(F.filter(near, lambda i: F.get(g, i) <= score))


def metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1, false positive rate and accuracy; 0 where a denominator is."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = div(tp, tp + fp), div(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), "fpr": div(fp, fp + tn), "accuracy": div(tp + tn, tp + fp + tn + fn)}


def curve(scores: DataFrame, grid: list[float] = GRID, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tp, fp, tn, fn, precision, recall, f1, fpr): each threshold of the grid, in one pass over the scores.

    Scores are counted by the last grid value they reach; running sums over at most len(grid) rows give every threshold.
    The grid's values must be equally spaced between 0 and 1.
    """
    spark = scores.sparkSession
    n = scores.groupBy(bucket(F.col(score), grid).alias("b")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    steps = spark.createDataFrame([(i, g) for i, g in enumerate([None, *grid])], "b int, threshold double")
    s = steps.join(n, "b", "left").fillna(0, ["pos", "neg"])
    up = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    s = s.withColumn("tp", F.sum("pos").over(up)).withColumn("fp", F.sum("neg").over(up))
    s = s.withColumn("tn", F.sum("neg").over(every) - F.col("fp")).withColumn("fn", F.sum("pos").over(every) - F.col("tp"))
    m = metrics(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return s.filter("threshold is not null").select("threshold", "tp", "fp", "tn", "fn", *(m[k].alias(k) for k in ("precision", "recall", "f1", "fpr")))


def pick(c: DataFrame, most_fpr: float = 0.01) -> DataFrame:
    """The threshold of best F1 among those of low false positive rate, of equal ones that of higher recall, then the lower; if
    none has a low rate, that of best F1 at all, then the lower."""
    low = F.col("fpr") <= most_fpr
    order = [F.desc(low), F.desc("f1"), F.when(low, -F.col("recall")).otherwise(0.0), F.asc("threshold")]
    return c.orderBy(*order).limit(1)


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, count, share of the actual class)."""
    t = df.groupBy(actual, predicted).agg(F.count("*").alias("count"))
    return t.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy(actual)), 6))


def evaluation(df: DataFrame, actual: str, predicted: str, positive) -> DataFrame:
    """One row of accuracy, precision, recall and F1 of a binary prediction."""
    a, p = F.col(actual) == positive, F.col(predicted) == positive
    n = df.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"), F.count_if(a & ~p).alias("fn"))
    m = metrics(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return n.select("tp", "fp", "tn", "fn", *(F.round(m[k], 6).alias(k) for k in ("accuracy", "precision", "recall", "f1")))


def weighted_evaluation(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 of all classes weighted by their support."""
    t = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    cells = t.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("n").alias("act"), F.lit(0).cast("long").alias("pred"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("act"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = cells.groupBy("c").agg(F.sum("act").alias("act"), F.sum("pred").alias("pred"), F.sum("hit").alias("hit"))
    m = metrics(F.col("hit"), F.col("pred") - F.col("hit"), F.lit(0), F.col("act") - F.col("hit"))
    per = per.select("act", "hit", *(m[k].alias(k) for k in ("precision", "recall", "f1")))
    w = lambda k: F.round(F.sum(F.col(k) * F.col("act")) / F.sum("act"), 6).alias(k)
    return per.agg(F.round(F.sum("hit") / F.sum("act"), 6).alias("accuracy"), w("precision"), w("recall"), w("f1"))


def distribution(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Least, greatest, mean, population deviation and quantiles of finite scores, of each group or of all rows.

    Quantiles are exact, by ranks within ranges of values of each group, so a group of any size is spread.
    """
    points = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    x = F.when(~F.isnan(score) & (F.abs(score) != float("inf")), F.col(score))
    d = df if by else df.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    g = d.groupBy(F.struct(*keys).alias("_g")).agg(F.min(x).alias("least"), F.max(x).alias("greatest"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"))
    q = by_group(d, keys, x, points)
    out = g.join(q, "_g", "left")
    return out.select(*(F.col(f"_g.{c}").alias(c) for c in by or []), "least", "greatest", "mean", "std", *(F.round(F.get("_q", F.lit(k)), 6).alias(f"q{int(p * 100):02d}") for k, p in enumerate(points)))


def repaired(df: DataFrame, score: str) -> DataFrame:
    """Scores that are no finite numbers become the median of those that are, 0 where none is."""
    x = F.when(~F.isnan(score) & (F.abs(score) != float("inf")), F.col(score))
    m = (quantiles(df.select(x.alias("_x")), "_x", [0.5]) or [0.0])[0]
    return df.withColumn(score, F.coalesce(x, F.lit(m)))


def anomaly_curve(scores: DataFrame, cuts: list[float], label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, pos, neg, recall, f1, precision, fpr) for each cut: what calling scores below it anomalies gives.

    Scores are counted by the first cut above them, so that running sums go over as many rows as there are cuts.
    """
    spark = scores.sparkSession
    cuts = sorted(set(cuts))
    over = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("_s"))) if cuts else F.lit(0)
    counts = scores.groupBy(F.col(score).alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    n = counts.groupBy(over.alias("b")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    steps = spark.createDataFrame([(k, c) for k, c in enumerate([*cuts, None])], "b int, threshold double").join(n, "b", "left").fillna(0, ["p", "q"])
    up, every = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    s = steps.select("threshold", F.sum("p").over(up).alias("tp"), F.sum("q").over(up).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum("q").over(every).alias("neg"))
    m = metrics(F.col("tp"), F.col("fp"), F.col("neg") - F.col("fp"), F.col("pos") - F.col("tp"))
    return s.filter("threshold is not null").select("threshold", "pos", "neg", *(m[k].alias(k) for k in ("recall", "f1", "precision", "fpr")))


def anomaly_threshold(scores: DataFrame, most_fpr: float = 0.05, candidates: int = 500, label: str = "label", score: str = "score") -> DataFrame:
    """Calibrate a threshold below which a score is an anomaly: of up to ``candidates`` quantiles the one of best (recall, f1,
    precision, -fpr) under the bound of the false positive rate; without any label of 1, the quantile at the bound."""
    cuts = quantiles(scores, score, [k / (candidates - 1) for k in range(candidates)])
    s = anomaly_curve(scores, cuts, label, score).filter(F.col("fpr") <= most_fpr)
    known = F.col("pos") > 0
    return s.orderBy(F.when(known, -F.col("recall")), F.when(known, -F.col("f1")), F.when(known, -F.col("precision")), F.when(known, F.col("fpr")), F.desc("threshold")).limit(1).drop("pos", "neg")


def calibrated(scores: DataFrame, target: float = 0.05, least_unsupervised: float = 0.08, label: str = "label", score: str = "score", candidates: int = 900) -> dict:
    """A threshold below which a score is an anomaly, with the policy that chose it, its figures, and the rows of either label.

    With both labels: of ``candidates`` quantiles, whatever the number of rows, the one of best (recall, f1, precision, -fpr) among those of a false positive rate
    of ``target`` at most.  If that finds less than a fifth of the attacks, higher caps are tried, and the best of them is
    taken if it gains enough.  Without attacks: the quantile of benign scores at the cap, ``least_unsupervised`` at least.
    Without any benign row, the 2 percent quantile of all; without rows, 0.
    """
    t = min(max(target, 0.01), 0.20)
    guard = min(max(least_unsupervised, t), 0.30)
    d = repaired(scores, score)
    kinds = d.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("attack")).first()
    out = {"threshold": 0.0, "selection_policy": "invalid_input", "target_fp_rate": t, "fpr": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0, "effective_fp_cap": t, "attack_support": kinds["attack"], "benign_support": kinds["benign"]}
    if not kinds["n"]:
        return out
    benign = d.filter(F.col(label) == 0)
    figures = ("threshold", "fpr", "precision", "recall", "f1")
    if kinds["attack"] and kinds["benign"]:
        found = anomaly_curve(d, quantiles(d, score, [0.001 + k * (0.994 / (candidates - 1)) for k in range(candidates)]), label, score)
        relaxed = sorted({max(t + 0.02, 0.05), 0.08, 0.12, 0.20})
        caps = d.sparkSession.createDataFrame([(c,) for c in [t, *(c for c in relaxed if c > t + 1e-12)]], "cap double")
        best = F.min_by(F.struct(*figures), F.struct(-F.col("recall"), -F.col("f1"), -F.col("precision"), F.col("fpr"), F.col("threshold")))
        rows = {r["cap"]: r["b"] for r in found.crossJoin(F.broadcast(caps)).filter(F.col("fpr") <= F.col("cap") + 1e-12).groupBy("cap").agg(best.alias("b")).collect()}  # five rows
        if t in rows:
            strict = rows.pop(t)
            out |= {k: strict[k] for k in figures} | {"selection_policy": "supervised_fp_bound"}
            if strict["recall"] < 0.20 and rows:
                cap, b = max(rows.items(), key=lambda x: (x[1]["recall"], x[1]["f1"], x[1]["precision"], -x[1]["fpr"], -x[0]))
                gain, f1 = b["recall"] - strict["recall"], b["f1"] - strict["f1"]
                if b["recall"] >= 0.20 and f1 >= -0.03 or gain >= 0.05 and f1 >= -0.02 or strict["recall"] <= 0.02 and b["recall"] >= 0.10:
                    out |= {k: b[k] for k in figures} | {"selection_policy": "supervised_fp_relaxed_for_recall", "effective_fp_cap": cap}
            return out
        policy, cap, threshold = "fp_quantile_fallback", t, quantiles(benign, score, [t])[0]
    elif kinds["benign"]:
        cap = max(t, guard)
        policy = "unsupervised_fp_quantile_guarded" if cap > t + 1e-12 else "unsupervised_fp_quantile"
        threshold = quantiles(benign, score, [cap])[0]
    else:
        policy, cap, threshold = "unsupervised_fp_quantile", t, quantiles(d, score, [0.02])[0]
    b = anomaly_curve(d, [threshold], label, score).first()
    return out | {k: b[k] for k in figures} | {"selection_policy": policy, "effective_fp_cap": cap}


def rate_errors(cases: DataFrame, grid: list[float] = GRID, file: str = "file", score: str = "score", expected: str = "expected_rate") -> DataFrame:
    """(threshold, mae, benign_most): for each threshold the mean error of the files' rates of alerts, and the greatest rate among
    files that should have none."""
    spark = cases.sparkSession
    n = cases.groupBy(file, expected, bucket(F.col(score), grid).alias("b")).agg(F.count("*").alias("n"))
    steps = spark.createDataFrame(list(enumerate([None, *grid])), "b int, threshold double")
    files = cases.select(file, expected).distinct().crossJoin(F.broadcast(steps))
    s = files.join(n, [file, expected, "b"], "left").fillna(0, ["n"])
    w = Window.partitionBy(file, expected)
    rate = F.sum("n").over(w.orderBy(F.desc("b"))) / F.sum("n").over(w)
    s = s.withColumn("rate", rate).filter("threshold is not null")
    return s.groupBy("threshold").agg(F.round(F.avg(F.abs(F.col("rate") - F.col(expected))), 6).alias("mae"), F.round(F.max(F.when(F.col(expected) == 0, F.col("rate"))), 6).alias("benign_most"))


def by_rates(errors: DataFrame, now: float, most_benign: float = 0.05) -> DataFrame:
    """(threshold, mae, benign_most, accepted): the threshold of least mean error, of those that keep benign files under ``most_benign``
    if there are any; accepted if it is better than the one in use by 0.25 points of error or 1 point of benign alerts."""
    good = F.coalesce(F.col("benign_most"), F.lit(0.0)) <= most_benign
    best = errors.orderBy(F.desc(good), "mae", F.coalesce(F.col("benign_most"), F.lit(0.0)), "threshold").limit(1)
    old = errors.filter(F.abs(F.col("threshold") - now) < 1e-9).select(F.col("mae").alias("_m"), F.coalesce("benign_most", F.lit(0.0)).alias("_b"))
    gain = (F.col("_m") - F.col("mae") >= 0.0025) | (F.col("_b") - F.coalesce("benign_most", F.lit(0.0)) >= 0.01)
    return best.join(F.broadcast(old), F.lit(True), "left").select("threshold", "mae", "benign_most", F.coalesce(gain, F.lit(True)).alias("accepted"))


def provenance(manifests: DataFrame) -> DataFrame:
    """manifests with thresholds_by_input_type, from recommended_threshold, domain, algorithm and calibration."""
    base, algorithm, domain = clamped(F.col("recommended_threshold")), F.col("algorithm"), F.col("dataset_type")
    cic, rf, xgb = domain == "CIC-IDS", algorithm == "Random Forest", algorithm == "XGBoost"
    floor20 = clamped(F.greatest(base, F.lit(0.20)))
    pcap = F.when(cic & rf, floor20).when(cic & xgb & F.col("has_hard_cases"), floor20).when(cic & xgb, 0.05)
    by_rate = F.col("selection_policy") == "holdout_rate_calibrated"
    csv = F.when(cic & rf, clamped(F.greatest(base, F.lit(0.30)))).when(cic & xgb & by_rate, base).when(cic & xgb, clamped(F.least(base, F.lit(0.02)))).when(domain == "NSL-KDD", 0.30).when(domain == "UNSW-NB15", base)
    return manifests.withColumns({"base_threshold": base, "pcap_threshold": pcap, "csv_threshold": csv, "policy_id": F.lit(POLICY)})


def resolved(pairs: DataFrame) -> DataFrame:
    """pairs of a manifest and an input with threshold, rule and source.

    A manifest of the current policy gives its threshold for the input type, else its base, raised by the guardrails of
    its domain; one of another policy goes by the older rules.
    """
    domain, algorithm, kind = F.col("dataset_type"), F.col("algorithm"), F.col("input_type")
    cic, rf, xgb, csv, cap = domain == "CIC-IDS", algorithm == "Random Forest", algorithm == "XGBoost", kind == "csv", kind == "pcap"
    base = F.coalesce("base_threshold", "recommended_threshold", F.lit(DEFAULT))
    own = F.when(cap, F.col("pcap_threshold")).when(csv, F.col("csv_threshold"))
    now = clamped(F.coalesce(own, base))
    lifted = cap & cic & rf & own.isNotNull() & (now <= 0.20) & (base > now)
    value = F.when(lifted, clamped(F.greatest(base, F.lit(0.20)))).when(csv & ((domain == "NSL-KDD") | (cic & rf)) & (now < 0.30), F.lit(0.30)).otherwise(now)
    rule = F.when(lifted, "pcap_calibrated_floor").when(csv & (domain == "NSL-KDD") & (now < 0.30), "nsl_csv_runtime_guardrail_030").when(csv & cic & rf & (now < 0.30), "cic_csv_rf_runtime_guardrail_030").when(own.isNotNull(), kind).otherwise("base_threshold")
    old = clamped(F.coalesce("recommended_threshold", F.lit(DEFAULT)))
    balanced = F.lower(F.coalesce(F.col("name"), F.lit(""))).contains("seed_balanced")
    older = [
        (cap & cic & rf, clamped(F.greatest(old, F.lit(0.20))), "cic_pcap_random_forest_calibrated_floor"),
        (cap & cic & xgb & F.col("has_hard_cases"), clamped(F.greatest(old, F.lit(0.20))), "cic_pcap_xgboost_hard_case"),
        (cap & cic & xgb, F.lit(0.05), "cic_pcap_xgboost"),
        (csv & cic & rf, clamped(F.greatest(old, F.lit(0.30))), "cic_csv_random_forest_guardrail_030"),
        (csv & cic & xgb, clamped(F.least(old, F.lit(0.02))), "cic_csv_xgboost"),
        (csv & (domain == "NSL-KDD"), F.lit(0.30), "nsl_csv_guardrail_030"),
        (csv & (domain == "UNSW-NB15") & balanced, clamped(F.least(old, F.lit(0.20))), "unsw_csv_seed_balanced"),
        (csv & (domain == "UNSW-NB15"), old, "unsw_csv_metadata"),
    ]
    old_value, old_rule = F, F
    for cond, v, r in older:
        old_value, old_rule = old_value.when(cond, v), old_rule.when(cond, r)
    current = F.col("policy_id").eqNullSafe(F.lit(POLICY))
    return pairs.withColumns(
        {
            "threshold": F.when(current, value).otherwise(old_value.otherwise(old)),
            "rule": F.when(current, rule).otherwise(old_rule.otherwise("default")),
            "source": F.when(current, "training_provenance").otherwise("legacy"),
            "policy": F.when(current, POLICY).otherwise(LEGACY),
        }
    )
