"""Scan history and model registry as tables: sessions, alerts, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_models(names: DataFrame, models: DataFrame, name: str = "name") -> DataFrame:
    """Names that the registry does not have yet."""
    return names.select(name).dropna().distinct().join(models.select(name), name, "left_anti")


def current(changes: DataFrame, key: str, at: str, then: str | None = None) -> DataFrame:
    """The latest state of each session from its change rows; of equal times that of the greatest ``then``."""
    last = F.max_by(F.struct(*changes.columns), F.struct(at, *([then] if then else [])))
    return changes.groupBy(F.col(key).alias("_key")).agg(last.alias("_last")).select("_last.*")


def saved(scans: DataFrame, models: DataFrame, name: str, model_id: str = "id", model_name: str = "name") -> tuple[DataFrame, DataFrame]:
    """What saving scans appends: (new rows of the registry, sessions with their model's id).

    Models that the registry lacks get the ids after its greatest, in the order of their names; scans without a model's name
    have a null id.
    """
    new = new_models(scans.withColumnRenamed(name, model_name).select(model_name), models, model_name)
    top = models.agg(F.coalesce(F.max(model_id), F.lit(0)).alias("_top"))
    at = F.row_number().over(Window.orderBy(model_name))  # names of models, not rows of scans
    new = new.withColumn(model_id, at).crossJoin(F.broadcast(top)).select((F.col(model_id) + F.col("_top")).cast("long").alias(model_id), model_name)
    known = models.select(F.col(model_id).cast("long").alias("model_id"), F.col(model_name).alias(name)).unionByName(new.select(F.col(model_id).alias("model_id"), F.col(model_name).alias(name)))
    return new, scans.join(known, name, "left")


def appended(table: DataFrame, path: str, batch: str) -> None:
    """Append rows to a table's folder; a batch that is appended again replaces its own rows."""
    table.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def totals(sessions: DataFrame, alerts: str) -> DataFrame:
    """One row: how many sessions, and how many alerts in all."""
    return sessions.agg(F.count("*").alias("sessions"), F.coalesce(F.sum(alerts), F.lit(0)).cast("long").alias("anomalies"))


def recent(sessions: DataFrame, at: str, key: str, n: int) -> DataFrame:
    return sessions.orderBy(F.desc(at), F.desc(key)).limit(n)


def view(sessions: DataFrame, models: DataFrame, on: Column, model_name: str, at: str, key: str, n: int = 200) -> DataFrame:
    """Recent sessions with their model's name, Unknown where it has gone."""
    r = recent(sessions, at, key, n)
    return r.join(models, on, "left").withColumn("model_name", F.coalesce(F.col(model_name), F.lit("Unknown")))


def attack_distribution(alerts: DataFrame) -> DataFrame:
    """Alerts by type, the most frequent first."""
    return alerts.sparkSession.sql("SELECT anomaly_type, count(*) AS count FROM {alerts} GROUP BY anomaly_type ORDER BY count DESC, anomaly_type", alerts=alerts)


def history_kpis(h: DataFrame, alerts: str, risk: str) -> DataFrame:
    return h.agg(F.count("*").alias("scans"), F.sum(F.coalesce(F.col(alerts), F.lit(0))).alias("alerts"), F.round(F.avg(F.coalesce(F.col(risk), F.lit(0.0))), 4).alias("mean_risk"))


def home_kpis(h: DataFrame, alerts: str, records: str, risk: str) -> DataFrame:
    """Mean risk, mean share of alerts (0 where there are no records) and peak risk."""
    share = F.coalesce(F.try_divide(F.col(alerts).cast("double"), F.when(F.col(records) != 0, F.col(records))), F.lit(0.0))
    return h.agg(F.round(F.avg(risk), 4).alias("mean_risk"), F.round(F.avg(share), 6).alias("mean_alert_rate"), F.round(F.max(risk), 4).alias("peak_risk"))


def alerts_by_model(h: DataFrame, model: str, alerts: str, n: int = 10) -> DataFrame:
    """Alerts of each model, null as a model of its own, the n largest."""
    return h.groupBy(model).agg(F.sum(alerts).alias("alerts")).orderBy(F.desc("alerts"), F.asc_nulls_last(model)).limit(n)


def severity_score(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, 3).when(confidence >= 0.7, 2).otherwise(1)


def kept_since(df: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    """Rows not older than some hours."""
    return df.filter(F.col(at).cast("timestamp") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def compatible(manifests: DataFrame, inputs: DataFrame) -> DataFrame:
    """(inputs x manifests) pairs that fit: same domain, the input's type among the model's; Isolation Forest takes captures only if
    it was calibrated with references."""
    fits = F.array_contains("compatible_input_types", F.col("input_type"))
    forest = (F.col("algorithm") != "Isolation Forest") | (F.col("input_type") != "pcap") | F.col("trained_on_pcap_metrics")
    return inputs.join(F.broadcast(manifests), "dataset_type").filter(fits & forest)


def ranked(pairs: DataFrame, per: str) -> DataFrame:
    """Models of each input by f1, recall and precision (missing ones last), then the newest, then name."""
    value = lambda m: F.desc(F.coalesce(F.col(m), F.lit(-1.0)))
    w = Window.partitionBy(per).orderBy(value("f1"), value("recall"), value("precision"), F.desc("saved_at"), F.desc("name"))
    return pairs.withColumn("model_rank", F.row_number().over(w))


def model_table(manifests: DataFrame, by: str = "f1", nature: tuple[str, ...] = (), algorithms: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> DataFrame:
    """Models of some domains, algorithms or names (all where none is given), the greatest ``by`` first, missing ones last."""
    for column, wanted in (("dataset_type", nature), ("algorithm", algorithms), ("name", names)):
        if wanted:
            manifests = manifests.filter(F.col(column).isin(*wanted))
    return manifests.orderBy(F.desc_nulls_last(by), "name")


# Calibrations that say nothing about attacks.
WEAK = ("invalid_input", "fp_quantile_fallback")


def safe(kind: Column, in_domain: Column) -> Column:
    """Whether a model may be chosen without being asked for: always, but on captures only for their own domain, and

    * Random Forest if its threshold, where it has one, is 0.35 at most, * XGBoost if it has one of 0.35 at most, * Isolation
    Forest if it was calibrated with references, on attacks, with a recall of 0.05 at least and not without labels.
    """
    t, algorithm, policy = F.col("recommended_threshold"), F.col("algorithm"), F.coalesce("selection_policy", F.lit(""))
    low = lambda c, cut: F.coalesce(c < cut, F.lit(False))
    forest = F.coalesce("trained_on_pcap_metrics", F.lit(False)) & ~low(F.col("attack_support"), 1) & ~low(F.col("calibration_recall"), 0.05) & ~policy.isin(*WEAK) & ~policy.startswith("unsupervised")
    rule = F.when(algorithm == "Random Forest", F.coalesce(t <= 0.35, F.lit(True))).when(algorithm == "XGBoost", F.coalesce(t <= 0.35, F.lit(False))).when(algorithm == "Isolation Forest", forest).otherwise(True)
    return (kind != "pcap") | ((F.col("dataset_type") == in_domain) & rule)


def chosen(pairs: DataFrame, per: str, active: Column) -> DataFrame:
    """(per, name, reason): the model that a scan takes of ranked pairs (see ranked) with is_safe.

    The active model if it is safe, else the best safe one: by rank, but on captures of flows the safe Isolation Forest of
    least threshold, then of greatest recall, if there is any.  Without a safe model, the best one that is not the active.
    """
    forest = (F.col("input_type") == "pcap") & (F.col("dataset_type") == "CIC-IDS") & (F.col("algorithm") == "Isolation Forest")
    order = F.struct(
        F.when(forest, 0).otherwise(1).alias("a"),
        F.when(forest, F.coalesce("if_threshold", F.lit(1.0))).otherwise(0.0).alias("b"),
        F.when(forest, -F.coalesce("calibration_recall", F.lit(0.0))).otherwise(0.0).alias("c"),
        F.when(forest, F.coalesce("saved_at", F.lit(""))).otherwise("").alias("d"),
        F.col("model_rank").alias("e"),
    )
    is_active = F.col("name").eqNullSafe(active)
    g = pairs.groupBy(per).agg(
        F.min_by(F.when(F.col("is_safe"), F.col("name")), F.when(F.col("is_safe"), order)).alias("best_safe"),
        F.min_by("name", "model_rank").alias("best"),
        F.min_by(F.when(~is_active, F.col("name")), F.when(~is_active, F.col("model_rank"))).alias("other"),
        F.max(F.when(is_active, F.col("name"))).alias("active"),
        F.bool_or(is_active & F.col("is_safe")).alias("active_safe"),
    )
    has, good = F.col("active").isNotNull(), F.col("best_safe").isNotNull()
    name = F.when(has & F.col("active_safe"), F.col("active")).when(good, F.col("best_safe")).when(has, F.coalesce("other", "best")).otherwise(F.col("best"))
    reason = F.when(has & F.col("active_safe"), "active").when(good & has, "active_skipped").when(good, "best_safe").when(has, "active_rejected_no_safe").otherwise("best_by_metrics")
    return g.select(per, name.alias("name"), reason.alias("reason"))
