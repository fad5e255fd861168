"""Reports on alerts: frequency tables, shares, timelines, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEVERITIES = {"critical": 4, "high": 3, "medium": 2, "low": 1, "safe": 0}


def rank(severity: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv))
    return F.coalesce(F.try_element_at(m, F.lower(severity)), F.lit(0))


def dominant(df: DataFrame, value: str, attack: str) -> DataFrame:
    """(value, dominant_attack): the most frequent attack of each value, the first by name of equal ones."""
    n = df.filter(F.col(attack).isNotNull()).groupBy(value, attack).agg(F.count("*").alias("n"))
    return n.groupBy(value).agg(F.min(F.struct(-F.col("n"), F.col(attack).alias("a")))["a"].alias("dominant_attack"))


def top(df: DataFrame, value: str, n: int | None = None, attack: str | None = None) -> DataFrame:
    """(value, count[, dominant_attack]) by falling count, then value; blank values do not count.

    With an attack column, rows are counted once by value and attack; both figures come from these counts.
    """
    clean = df.filter(F.trim(F.col(value).cast("string")) != "")
    if attack:
        pairs = clean.groupBy(value, attack).agg(F.count("*").alias("n"))
        best = F.min(F.when(F.col(attack).isNotNull(), F.struct(-F.col("n"), F.col(attack).alias("a"))))["a"]
        t = pairs.groupBy(value).agg(F.sum("n").alias("count"), best.alias("dominant_attack"))
    else:
        t = clean.groupBy(value).agg(F.count("*").alias("count"))
    t = t.orderBy(F.desc("count"), value)
    return t.limit(n) if n else t


def top_share(df: DataFrame, value: str) -> DataFrame:
    """The most frequent value, its count and its share of all in percent."""
    t = df.filter(F.trim(F.col(value).cast("string")) != "").groupBy(value).agg(F.count("*").alias("count"))
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col(value).alias("v")))
    one = t.agg(best.alias("b"), F.sum("count").alias("total"))
    return one.select(F.lit(value).alias("column"), F.col("b.v").cast("string").alias("value"), (-F.col("b.n")).alias("count"), F.round(-F.col("b.n") * 100 / F.col("total"), 2).alias("share"))


def indicators(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """(column, value, count): the n most frequent values of several columns, in one pass over the rows."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    t = long.filter(F.trim("value") != "").groupBy("column", "value").agg(F.count("*").alias("count"))
    at = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    return t.withColumn("_r", at).filter(F.col("_r") <= n).drop("_r")


def shares(df: DataFrame, by: str) -> DataFrame:
    """(by, count, share in percent)."""
    t = df.groupBy(by).agg(F.count("*").alias("count"))
    return t.withColumn("share", F.round(F.col("count") * 100 / F.sum("count").over(Window.partitionBy()), 2))


def severities(df: DataFrame, severity: str = "severity") -> DataFrame:
    """Shares of severities with their rank, the worst first."""
    return shares(df, severity).withColumn("rank", rank(F.col(severity))).orderBy(F.desc("rank"), severity)


def histogram(df: DataFrame, value: str, by: str, bins: int = 25) -> DataFrame:
    """(by, bin, count): values in equal bins from the least to the greatest of all."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)))
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(by, at.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def timeline(df: DataFrame, ts: str, unit: str = "minute") -> DataFrame:
    """(at, alerts, is_peak): alerts a minute, or another unit; times that can't be read are left out."""
    t = df.select(F.date_trunc(unit, F.col(ts).try_cast("timestamp")).alias("at")).dropna().groupBy("at").agg(F.count("*").alias("alerts"))
    return t.withColumn("is_peak", F.col("alerts") == F.max("alerts").over(Window.partitionBy()))


def details(df: DataFrame, severity: str, confidence: str, *then: str, n: int = 100) -> DataFrame:
    """The n worst rows: by severity, then confidence."""
    return df.orderBy(F.desc(rank(F.col(severity))), F.desc(confidence), *then).limit(n)


def top_map(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """One row: a map of the n most frequent values to their counts."""
    t = top(df, value, n)  # n rows
    return t.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(value), F.col("count"))))).alias("top"))


def generic_share(df: DataFrame, generic: Column, least: float = 0.5) -> DataFrame:
    """Share of alerts with a generic label, and whether that calls for a notice."""
    return df.agg(F.avg(generic.cast("double")).alias("share")).select(F.round("share", 4).alias("share"), (F.col("share") >= least).alias("notice"))


def focus(df: DataFrame, columns: list[str], attack: str, places: int = 1) -> DataFrame:
    """(column, place, value, count, share, dominant_attack): of each column its ``places`` most frequent values.

    The rows are counted once, by column, value and attack.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns))).alias("x"), F.col(attack).alias("_a")).select("x.*", "_a")
    pairs = long.filter("value <> ''").groupBy("column", "value", "_a").agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("_a").isNotNull(), F.struct(-F.col("n"), F.col("_a").alias("a"))))["a"]
    t = pairs.groupBy("column", "value").agg(F.sum("n").alias("count"), best.alias("dominant_attack"))
    w = Window.partitionBy("column")
    t = t.withColumn("share", F.round(F.col("count") * 100 / F.sum("count").over(w), 2)).withColumn("place", F.row_number().over(w.orderBy(F.desc("count"), "value")))
    return t.filter(F.col("place") <= places).select("column", "place", "value", "count", "share", "dominant_attack")


#: What to do about a family's most frequent values: (family, column, values or None for all others, action, share for P1).
RULES = (
    ("NSL-KDD", "protocol_type", ("tcp",), "Check bursts of TCP sessions and limit connections at the perimeter", 35.0),
    ("NSL-KDD", "protocol_type", ("udp",), "Check UDP bursts and limit amplification by DNS and NTP", 35.0),
    ("NSL-KDD", "protocol_type", ("icmp",), "Check ICMP floods and scans and limit the rate of ICMP", 35.0),
    ("NSL-KDD", "protocol_type", None, "Check anomalies of the protocol against the access lists", 35.0),
    ("NSL-KDD", "service", ("ftp", "ftp_data", "telnet", "ssh", "http", "smtp"), "Harden the service: lockout, limited sources, more logging of failed sessions", 30.0),
    ("NSL-KDD", "service", None, "Check the service's profile and who may reach it", 30.0),
    ("NSL-KDD", "flag", ("s0",), "Check for SYN floods and scans: SYN cookies, limits of half-open sessions", 30.0),
    ("NSL-KDD", "flag", ("rej",), "Check rejected connections: scanning or brute force", 30.0),
    ("NSL-KDD", "flag", ("rstr",), "Check forced resets: attempts to break sessions", 30.0),
    ("NSL-KDD", "flag", None, "Check the flag's pattern in the correlation rules", 30.0),
    ("UNSW-NB15", "proto", ("tcp",), "Check bursts of TCP sessions and the access lists of critical segments", 35.0),
    ("UNSW-NB15", "proto", ("udp",), "Check UDP bursts and limit busy services", 35.0),
    ("UNSW-NB15", "proto", ("icmp",), "Check ICMP scans and floods and limit the rate of ICMP", 35.0),
    ("UNSW-NB15", "proto", None, "Check the protocol's profile in flow records", 35.0),
    ("UNSW-NB15", "service", ("ftp", "ftp-data", "http", "https", "smtp", "dns", "ssh"), "Harden the service: limited sources, lockout, audited access", 30.0),
    ("UNSW-NB15", "service", None, "Check the service's profile and its access rules", 30.0),
    ("UNSW-NB15", "state", ("con",), "Check lasting connections with suspicious sources", 30.0),
    ("UNSW-NB15", "state", ("fin",), "Check frequent ends of sessions against failed logins", 30.0),
    ("UNSW-NB15", "state", ("int",), "Check interrupted sessions: scans or attempts to get round policies", 30.0),
    ("UNSW-NB15", "state", ("req",), "Check masses of requests to one service", 30.0),
    ("UNSW-NB15", "state", None, "Check the connections' state in the correlation rules", 30.0),
    ("CIC-IDS", "src_ip", None, "Block the source or limit its rate at the perimeter for now", 30.0),
    ("CIC-IDS", "dst_port", ("53",), "Limit the rate of DNS and check the resolvers", 25.0),
    ("CIC-IDS", "dst_port", ("22", "23", "3389", "445"), "Harden access to the port: access lists, second factor, lockout", 25.0),
    ("CIC-IDS", "dst_port", None, "Check the firewall's rules for the port and limit access for now", 25.0),
)
#: The columns that each family is looked at by, in order.
FOCUS = {"NSL-KDD": ("protocol_type", "service", "flag"), "UNSW-NB15": ("proto", "service", "state"), "CIC-IDS": ("src_ip", "dst_port")}
# Names of attacks that name none.
GENERIC = ("anomaly", "attack", "unknown", "suspicious", "malicious", "1", "1.0")


def action_plan(alerts: DataFrame, family: str, attack: str, risk: float, n: int = 5) -> DataFrame:
    """(seq, priority, column, value, action, share): at most n steps against the alerts of a scan.

    First the most frequent attack; then a rule for the most frequent value of each of the family's columns, of source
    addresses for the three most frequent; last, if half of the alerts have a generic label, a model that names attacks.
    """
    spark = alerts.sparkSession
    columns = [c for c in FOCUS[family] if c in alerts.columns]
    rows = focus(alerts, [attack, *columns], attack, 3).filter((F.col("place") == 1) | (F.col("column") == "src_ip"))
    order = {c: k for k, c in enumerate(columns, 1)}
    rules = spark.createDataFrame([(c, v, action, cut) for f, c, values, action, cut in RULES if f == family for v in values or (None,)], "r_column string, r_value string, r_action string, cut double")
    own = rows.join(rules, (F.col("column") == F.col("r_column")) & (F.col("r_value") == F.lower("value")), "left_outer").select(*rows.columns, F.col("r_action").alias("action"), "cut")
    others = rules.filter("r_value is null").select(F.col("r_column").alias("column"), F.col("r_action").alias("_action"), F.col("cut").alias("_cut"))
    own = own.join(others, "column", "left").withColumn("action", F.coalesce("action", "_action")).withColumn("cut", F.coalesce("cut", "_cut"))
    first = F.col("column") == attack
    seq = F.when(first, 0)
    for c, k in order.items():
        seq = seq.when(F.col("column") == c, 10 * k + F.col("place"))
    plan = own.select(
        seq.alias("seq"),
        F.when(first, "P1" if risk >= 40 else "P2").when(F.col("share") >= F.col("cut"), "P1").otherwise("P2").alias("priority"),
        "column",
        "value",
        F.when(first, "Isolate the sources of the attack and open an incident").otherwise(F.col("action")).alias("action"),
        "share",
    )
    share = alerts.agg(F.round(F.avg(F.lower(F.trim(attack)).isin(*GENERIC).cast("double")) * 100, 2).alias("share")).filter("share >= 50")
    last = share.select(F.lit(99).alias("seq"), F.lit("P2").alias("priority"), F.lit(attack).alias("column"), F.lit(None).cast("string").alias("value"), F.lit("Use a supervised model, which names attacks").alias("action"), "share")
    return plan.unionByName(last).orderBy("seq").limit(n)


def improvement(summary: DataFrame, focus_rows: DataFrame) -> DataFrame:
    """(anomaly_share, target_share, top_share, target_top): what the next scan should come down to, in percent."""
    lead = focus_rows.agg(F.max("share").alias("top_share"))
    share, top_ = F.col("risk_score"), F.col("top_share")
    target = F.greatest(F.lit(0.5), share - F.greatest(F.lit(5.0), share * 0.3))
    target_top = F.greatest(F.lit(20.0), top_ - F.greatest(F.lit(10.0), top_ * 0.25))
    return summary.crossJoin(F.broadcast(lead)).select(share.alias("anomaly_share"), F.round(target, 4).alias("target_share"), "top_share", F.when(top_.isNotNull(), F.round(target_top, 4)).alias("target_top"))


def recommendations(alerts: DataFrame, attack: str) -> DataFrame:
    """(attack, count, threat, action): what to do about each attack, the most frequent first; generic labels are passed over."""
    from . import threats

    named = top(alerts.filter(~F.lower(F.trim(attack)).isin(*GENERIC)), attack)
    return named.join(threats.looked_up(named, attack), attack).select(attack, "count", "threat", "action").orderBy(F.desc("count"), attack)


def benchmark_matrix(models: DataFrame, inputs: DataFrame) -> DataFrame:
    """Each ready model with each input of its domain; captures only for models optimised for them, Isolation Forest only if it
    was calibrated with references."""
    capture = F.col("input_type") == "pcap"
    forest = (F.col("algorithm") != "Isolation Forest") | F.col("trained_on_pcap_metrics")
    return models.filter("status = 'OK'").join(inputs, "dataset_type").filter(~capture | (F.col("optimize_for_pcap") & forest))


def rate_verdicts(df: DataFrame, predicted: Column, expected: Column, failed: Column, most: float = 0.08) -> DataFrame:
    """OK, POOR, NO_TARGET or ERROR for each benchmark row."""
    return df.withColumn("verdict", F.when(failed, "ERROR").when(expected.isNull(), "NO_TARGET").when(F.abs(predicted - expected) > most, "POOR").otherwise("OK"))


def benchmark_summary(df: DataFrame) -> DataFrame:
    """Counts by verdict, and the distinct families and algorithms."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v.lower())
    return df.agg(F.count("*").alias("runs"), n("OK"), n("POOR"), n("NO_TARGET"), n("ERROR"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.count_distinct("algorithm").alias("algorithms"))
