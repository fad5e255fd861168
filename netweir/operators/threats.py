"""The threat catalogue and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan

# Known attack labels with name, severity and the label that another name stands for, in the order in which parts
# of labels are looked for.
CATALOGUE = (
    ("ddos", "Distributed denial of service", "critical"), ("ddos attack", "ddos"), ("dos hulk", "DoS Hulk", "high"), ("dos goldeneye", "DoS GoldenEye", "high"),
    ("dos slowloris", "DoS slowloris", "high"), ("dos slowhttptest", "DoS slow HTTP test", "high"), ("dos", "Denial of service", "high"), ("ftp-patator", "FTP brute force", "high"),
    ("ssh-patator", "SSH brute force", "high"), ("bruteforce", "Brute force", "high"), ("brute force -web", "bruteforce"), ("web attack – brute force", "Web brute force", "high"),
    ("web attack – xss", "Cross-site scripting", "high"), ("web attack – sql injection", "SQL injection", "critical"), ("sql injection", "web attack – sql injection"), ("xss", "web attack – xss"),
    ("portscan", "Port scan", "medium"), ("probe", "Probe", "medium"), ("reconnaissance", "Reconnaissance", "medium"), ("bot", "Botnet", "critical"), ("infiltration", "Infiltration", "critical"),
    ("heartbleed", "Heartbleed", "critical"), ("r2l", "Remote to local", "high"), ("u2r", "User to root", "critical"), ("exploits", "Exploits", "critical"), ("fuzzers", "Fuzzers", "medium"),
    ("generic", "Generic attack", "medium"), ("shellcode", "Shellcode", "critical"), ("worms", "Worms", "critical"), ("analysis", "Analysis", "medium"), ("backdoor", "Backdoor", "critical"),
    ("backdoors", "backdoor"), ("synflood", "SYN flood", "high"), ("udpflood", "UDP flood", "high"), ("ddos attack-loic-udp", "ddos"), ("ddos attack-hoic", "ddos"), ("ddos attacks-loic-http", "ddos"),
    ("ddos attack-loic-http", "ddos"), ("dos attacks-hulk", "dos hulk"), ("dos attacks-slowhttptest", "dos slowhttptest"), ("dos attacks-goldeneye", "dos goldeneye"), ("dos attacks-slowloris", "dos slowloris"),
    ("brute force -xss", "web attack – xss"), ("ftp brute force", "ftp-patator"), ("ssh brute force", "ssh-patator"), ("ddos-атака", "ddos"), ("dos-атака", "dos"), ("dos (goldeneye)", "dos goldeneye"),
    ("dos (hulk)", "dos hulk"), ("dos (slowloris)", "dos slowloris"), ("dos (slowhttp)", "dos slowhttptest"), ("сканування портів", "portscan"), ("ботнет", "bot"), ("вторгнення", "infiltration"),
    ("веб-атака (brute force)", "web attack – brute force"), ("веб-атака (xss)", "web attack – xss"), ("sql-ін'єкція", "web attack – sql injection"), ("експлойт", "exploits"), ("бекдор", "backdoor"),
    ("хробак", "worms"), ("шелл-код", "shellcode"), ("розвідка", "reconnaissance"), ("фаззінг", "fuzzers"), ("brute force", "bruteforce"), ("вразливість heartbleed", "heartbleed"),
)
ACTIONS = {"critical": "Isolate the hosts involved and start incident response", "high": "Block the source and review affected services", "medium": "Watch the source and check the rules of the firewall", "low": "Keep a record and compare with the baseline", "safe": "No action needed"}
DEFAULT = "medium"
BENIGN = ("benign", "normal")


def catalogue(spark: SparkSession) -> DataFrame:
    """(key, name, severity, action, ord): entries, and aliases with what they stand for; some dozens of rows."""
    own = {row[0]: row[1:] for row in CATALOGUE if len(row) == 3}
    rows = [(key, *own[key if key in own else rest[0]], k) for k, (key, *rest) in enumerate(CATALOGUE)]
    return spark.createDataFrame([(key, n, s, ACTIONS[s], k) for key, n, s, k in rows], "key string, threat string, threat_severity string, action string, ord int")


def looked_up(labels: DataFrame, label: str) -> DataFrame:
    """(label, threat, threat_severity, action) for each distinct label: by its exact key, else by the first key of more than three
    characters that the label contains, else the label itself, of medium severity."""
    c = F.broadcast(catalogue(labels.sparkSession))  # 65 rows
    d = labels.select(label).dropna().distinct().withColumn("_k", F.lower(F.trim(label)))
    exact = d.join(c, F.col("_k") == F.col("key")).select(label, F.struct(F.lit(-1).alias("ord"), "threat", "threat_severity", "action").alias("t"))
    part = d.join(c, F.col("_k").contains(F.col("key")) & (F.length("key") > 3)).select(label, F.struct("ord", "threat", "threat_severity", "action").alias("t"))
    best = exact.unionByName(part).groupBy(label).agg(F.min("t").alias("t"))
    found = d.join(best, label, "left")
    safe = F.col("_k").isin(*BENIGN)
    return found.select(
        label,
        F.when(safe, "Normal").otherwise(F.coalesce("t.threat", F.trim(label))).alias("threat"),
        F.when(safe, "safe").otherwise(F.coalesce("t.threat_severity", F.lit(DEFAULT))).alias("threat_severity"),
        F.when(safe, ACTIONS["safe"]).otherwise(F.coalesce("t.action", F.lit(ACTIONS[DEFAULT]))).alias("action"),
    )


def enriched(df: DataFrame, label: str, score: str | None = None) -> DataFrame:
    """df with threat, severity, recommended action, whether it is one, and the reason; severities go by anomaly score if given."""
    e = df.join(looked_up(df, label), label, "left")
    severity = scan.anomaly_severity(F.col(score)) if score else F.col("threat_severity")
    threat = F.col("threat_severity") != "safe"
    e = e.withColumn("is_threat", threat).withColumn("severity", F.when(threat, severity).otherwise("safe")).drop("threat_severity")
    return e.withColumn("reason", F.format_string("%s (%s)", "threat", "severity"))


def display_name(df: DataFrame, label: str, algorithm: str = "", to: str = "attack_name") -> DataFrame:
    """df with a name to show: Normal traffic, Anomaly for labels that name no attack, else the catalogue's name with the label."""
    from ..functions.expressions import is_benign
    from .report import GENERIC

    bare = F.trim(F.col(label))
    none = "Anomaly (not classified by this model)" if algorithm == "Isolation Forest" else "Anomaly (kind unknown)"
    known = looked_up(df.select(label), label).select(F.col(label).alias("_l"), "threat")
    d = df.join(known, F.col(label) == F.col("_l"), "left")
    name = F.when(F.coalesce(bare, F.lit("")) == "", "Anomaly (kind unknown)").when(is_benign(bare), "Normal traffic").when(F.lower(bare).isin(*GENERIC), none).when(F.lower("threat") == F.lower(bare), bare).otherwise(F.concat("threat", F.lit(" ("), bare, F.lit(")")))
    return d.select(*df.columns, name.alias(to))
