"""Adapters: ledger and event tables in the shape of packets, flows, names, logs and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(col: str) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))") / F.lit(1e6)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: the user is the source, the kind of event the destination and, for two kinds, the sender."""
    e = read(spark, sf_dir, "events")
    flags = F.create_map(*[F.lit(x) for kv in {"signup": 2, "view": 16, "click": 24, "purchase": 17, "error": 4}.items() for x in kv])
    return e.select(
        F.col("event_id").alias("seq"),
        seconds("ts").alias("ts"),
        F.col("user_id").alias("src"),
        F.col("event_type").alias("dst"),
        F.get_json_object("props", "$.k").cast("int").alias("dst_port"),
        F.col("value").alias("packet_len"),
        F.element_at(flags, F.col("event_type")).alias("tcp_flags"),
        F.col("event_type").isin("error", "purchase").alias("is_reply"),
    )


PKT_SQL = """pkt AS (SELECT event_id AS seq, epoch_us(ts) / 1e6 AS ts, user_id AS src, event_type AS dst, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS dst_port,
  value AS packet_len, CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 16 WHEN 'click' THEN 24 WHEN 'purchase' THEN 17 WHEN 'error' THEN 4 END AS tcp_flags,
  event_type IN ('error', 'purchase') AS is_reply FROM events)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as flows from supplier to the customer's nation. ord: the total order in which flows are scored; (ok, ln, pk, src) names one, as pk holds part and day."""
    li, o, c = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    start = seconds("l_shipdate")
    return joined.select(
        F.struct(start.alias("t"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        (F.col("l_partkey") * 100000 + F.floor(start / DAY).cast("long")).alias("pk"),
        F.col("l_suppkey").alias("src"),
        F.col("c_nationkey").alias("dst"),
        start.alias("start"),
        (start + F.col("l_linenumber") * 3600.0).alias("last"),
        F.col("l_extendedprice").alias("bytes"),
        F.col("l_quantity").alias("packets"),
        F.col("l_linestatus").alias("proto"),
        (F.col("l_returnflag") == "R").alias("syn_only"),
        (F.col("l_returnflag") != "N").alias("reverse_seen"),
        (F.col("l_partkey") % 1024).cast("int").alias("port"),
    )


FLW_SQL = """flw AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey * 100000 + floor(epoch_us(l_shipdate) / 8.64e10)::BIGINT AS pk, l_suppkey AS src, c_nationkey AS dst, epoch_us(l_shipdate) / 1e6 AS start,
  epoch_us(l_shipdate) / 1e6 + l_linenumber * 3600.0 AS last, l_extendedprice AS bytes, l_quantity AS packets, l_linestatus AS proto,
  l_returnflag = 'R' AS syn_only, l_returnflag <> 'N' AS reverse_seen, (l_partkey % 1024)::INTEGER AS port
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as queried names: the host of the address."""
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("qname"))


NAMES_SQL = "qnm AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS qname FROM pages)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as an append-only log: a record per turn."""
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


LOG_SQL = "log AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as scored rows: y is the label, group the source, score a fixed function of the id."""
    d, x = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels")
    score = F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0
    return x.join(d, "doc_id").select("doc_id", F.col("toxic").alias("y"), score.alias("score"), F.col("source").alias("group"))


LAB_SQL = "lab AS (SELECT l.doc_id, l.toxic AS y, (l.doc_id * 7919 % 1000) / 1000.0 AS score, d.source AS \"group\" FROM labels l JOIN documents d USING (doc_id))"


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as alerts of a log: class, severity, host, time, campaign (or null), provisional or not."""
    e = read(spark, sf_dir, "events")
    severity = F.when(F.col("value") >= 90, "CRITICAL").when(F.col("value") >= 60, "HIGH").when(F.col("value") >= 30, "MEDIUM").otherwise("LOW")
    return e.select(
        F.col("event_id").alias("alert_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.upper("event_type").alias("threat_class"),
        severity.alias("severity"),
        F.col("user_id").alias("host"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("camp-"), (F.col("user_id") % 20).cast("string"))).alias("campaign_id"),
        (F.col("event_id") % 7 == 0).alias("provisional"),
    )


ALERTS_SQL = """alr AS (SELECT event_id AS alert_id, ts, upper(event_type) AS threat_class,
  CASE WHEN value >= 90 THEN 'CRITICAL' WHEN value >= 60 THEN 'HIGH' WHEN value >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity, user_id AS host,
  CASE WHEN event_id % 3 = 0 THEN 'camp-' || (user_id % 20) END AS campaign_id, event_id % 7 = 0 AS provisional FROM events)"""
