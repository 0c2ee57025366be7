"""Queries over the alert log as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.flows import ordered_distinct
from flowloom.operators.rules import severity_name, severity_rank


def search(log: DataFrame, threat_class: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    """The newest alerts, equal times by id; limit between 1 and 1000."""
    if severity is not None and severity not in ("LOW", "MEDIUM", "HIGH", "CRITICAL"):
        raise ValueError(f"unknown severity {severity}")
    out = log
    if threat_class is not None:
        out = out.filter(F.col("threat_class") == threat_class)
    if severity is not None:
        out = out.filter(F.col("severity") == severity)
    return out.orderBy(F.desc("ts"), F.desc("alert_id")).limit(max(1, min(1000, limit)))


def find(log: DataFrame, alert_id: str | int) -> DataFrame:
    """The one alert of an id; none is an error."""
    found = log.filter(F.col("alert_id") == alert_id).limit(1)
    if found.isEmpty():
        raise LookupError(f"no alert {alert_id}")
    return found


def count(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("alerts"))


def latest_correlated(log: DataFrame, limit: int = 5000, seq: str = "alert_id") -> DataFrame:
    """The newest alerts that have a campaign, limit between 1 and 50000: what the summary is of, as a report's bound."""
    return log.filter("campaign_id is not null").orderBy(F.desc(seq)).limit(max(1, min(50_000, limit)))


def campaigns(log: DataFrame, seq: str = "alert_id", tactic: str | None = None) -> DataFrame:
    """Per campaign: alerts, times, highest severity, hosts and classes (and tactics, a column) in order of first sight."""
    listed = lambda c: F.array_join(F.transform(ordered_distinct(c, seq), lambda h: h.cast("string")), ",")
    tactics = [listed(tactic).alias("tactics")] if tactic else []
    return log.filter("campaign_id is not null").groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        severity_name(F.max(severity_rank("severity"))).alias("severity"),
        listed("host").alias("hosts"),
        listed("threat_class").alias("classes"),
        *tactics,
    )


def campaign_summaries(log: DataFrame, limit: int = 5000, seq: str = "alert_id") -> DataFrame:
    """campaigns() of latest_correlated(), with tactics, newest first."""
    from flowloom.operators import correlate

    tagged = latest_correlated(log, limit, seq).withColumn("__tactic", correlate.tactic("threat_class"))
    return campaigns(tagged, seq, "__tactic").orderBy(F.desc("last_seen"), "campaign_id")


def campaign_detail(log: DataFrame, campaign_id: str, limit: int = 5000) -> DataFrame:
    return log.filter(F.col("campaign_id") == campaign_id).orderBy("alert_id").limit(limit)


def host_timeline(log: DataFrame, host: int | None = None) -> DataFrame:
    """Per host and class: alerts, first and last time."""
    rows = log if host is None else log.filter(F.col("host") == host)
    return rows.groupBy("host", "threat_class").agg(F.count(F.lit(1)).alias("alerts"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def host_stages(log: DataFrame, host: int | str | None = None, seq: str = "alert_id") -> DataFrame:
    """Per host, tactic and class: alerts, first and last time, campaigns in order of first sight; in order of the first time."""
    from flowloom.operators import correlate

    rows = (log if host is None else log.filter(F.col("host") == host)).withColumns({"tactic": correlate.tactic("threat_class"), "tactic_id": correlate.tactic_id("threat_class")})
    found = F.filter(ordered_distinct("campaign_id", seq), lambda c: c.isNotNull())
    per = rows.groupBy("host", "tactic_id", "tactic", "threat_class").agg(F.count(F.lit(1)).alias("alerts"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.array_join(found, ",").alias("campaigns"))
    return per.orderBy("first_seen", "host", "threat_class")


def class_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("threat_class").agg(F.count_if("provisional").alias("provisional"), F.count_if(~F.col("provisional")).alias("confirmed"), F.max("ts").alias("last_seen"))


def neighbourhood(log: DataFrame, seq: int, around: int = 2) -> DataFrame:
    return log.filter(F.col("alert_id").between(seq - min(5, max(0, around)), seq + min(5, max(0, around))))


def manifest(log: DataFrame, versions: tuple[str, ...] = ()) -> DataFrame:
    """Records, first and last time, different severities, and the sorted different values of version columns."""
    listed = [F.array_join(F.array_sort(F.collect_set(v)), ",").alias(v) for v in versions]
    return log.agg(F.count(F.lit(1)).alias("records"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("severity").alias("severities"), *listed)


def health(log: DataFrame | None, progress: list[dict] | None = None) -> dict:
    """What is known of a run: alerts, rows a second and batch times; null where nothing is attached."""
    from flowloom.streaming.sessions import rates

    return {"status": "OK", "alerts": None if log is None else log.count(), "source": "query" if progress else "not_connected", **rates(progress or [])}


def upgrade(v1: DataFrame) -> DataFrame:
    """Version 1 documents as version 2: what was not measured then stays null."""
    new = {"observability_state": "string", "window_id": "string", "campaign_id": "string", "provisional_id": "string"}
    return v1.withColumns({c: F.lit(None).cast(t) for c, t in new.items() if c not in v1.columns}).withColumn("schema_version", F.lit(2))


def rechain(old: DataFrame, seq: str, document: str) -> DataFrame:
    """Records of a log without a chain (version 2) with seq from 0, prev_hash and record_hash (version 3), in order of seq. What
    cannot be read (a null document) is chained as found, never dropped: as an object with no fields."""
    from flowloom.operators import folds
    from pyspark.sql.window import Window

    place = (F.row_number().over(Window.orderBy(seq)) - 1).cast("long")
    rows = old.withColumns({document: F.coalesce(document, F.lit("{}")), "__seq": place}).drop(seq).withColumnRenamed("__seq", seq)
    return rows.join(folds.chain(rows, [], F.col(document), seq), seq)
