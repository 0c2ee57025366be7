"""Sinks and sources of logs, dumps, lists and labels."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """item: the lines of a list, without comments and blanks. A missing file is an empty list."""
    try:
        lines = spark.read.text(path)
    except Exception as e:  # Spark's error for a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "item string")
    return lines.select(F.trim(F.regexp_replace("value", "#.*", "")).alias("item")).filter("item <> ''").distinct()


def write_dump(rows: DataFrame, path: str) -> None:
    """Feature rows as compressed CSV with a header; undefined values are empty."""
    rows.write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(path)


def read_dump(spark: SparkSession, path: str, schema: str, inputs: list[str] | None = None) -> DataFrame:
    """A dump to learn from; inputs that name a host, flow or time are refused before anything is read."""
    from flowloom.operators.ml import refuse_identity

    refuse_identity(inputs or [])
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_flow_labels(spark: SparkSession, path: str, zone: str = "Europe/Prague") -> DataFrame:
    """Labelled flow lists (CSV; start in local time of the zone): key, s, e, code. The key is the same for both directions; ports may be
    hexadecimal; ICMP is keyed by its hosts."""
    raw = spark.read.option("header", "true").csv(path)
    # the zone's clock, then UTC seconds; independent of the session's zone
    start = F.to_timestamp_ntz("StartTime", F.lit("yyyy/MM/dd HH:mm:ss.SSSSSS"))
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), start)
    s = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc) / F.lit(1e6)
    return raw.select(label_key("Proto", "SrcAddr", "Sport", "DstAddr", "Dport").alias("key"), s.alias("s"), (s + F.col("Dur").cast("double")).alias("e"), F.col("Label").alias("code"))


def label_key(protocol: str, src: str, sport: str, dst: str, dport: str) -> Column:
    number = lambda p: F.coalesce(F.when(F.col(p).cast("string").startswith("0x"), F.conv(F.substring(F.col(p).cast("string"), 3, 8), 16, 10)).otherwise(F.col(p).cast("string")), F.lit(""))
    icmp = F.lower(F.col(protocol)).startswith("icmp")
    end = lambda ip, p: F.concat_ws("|", F.col(ip), F.when(icmp, F.lit("")).otherwise(number(p)))
    a, b = end(src, sport), end(dst, dport)
    return F.concat_ws("~", F.lower(F.col(protocol)), F.least(a, b), F.greatest(a, b))


def append_alerts(spark: SparkSession, alerts: DataFrame, path: str, id_column: str = "alert_id") -> int:
    """Append alerts to a Parquet log; ids that it has, or that come twice, are an error, and nothing is written then."""
    fresh = alerts
    twice = fresh.groupBy(id_column).count().filter("count > 1").limit(1).count()
    try:
        known = spark.read.parquet(path).select(id_column)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    if twice or (known is not None and fresh.join(known, id_column, "left_semi").limit(1).count()):
        raise ValueError("an alert id is there already")
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def append_chained(spark: SparkSession, alerts: DataFrame, path: str, document: str = "document", id_column: str = "alert_id") -> int:
    """Append alerts (in order of ts and id) to a Parquet log as a hash chain: seq, prev_hash, record_hash. Ids that the log has, or that
    come twice, are an error. A batch is a folder named by its first seq, and is never written over: of two writers that begin at the
    same head, one fails."""
    from flowloom.operators.folds import GENESIS, chain

    log = _existing(spark, path)
    if alerts.groupBy(id_column).count().filter("count > 1").limit(1).count() or (log is not None and alerts.join(log.select(id_column), id_column, "left_semi").limit(1).count()):
        raise ValueError("an alert id is there already")
    last = None if log is None else log.agg(F.max("seq").alias("seq"), F.max_by("record_hash", "seq").alias("head")).first()
    first, head = (0, GENESIS) if last is None or last.seq is None else (last.seq + 1, last.head)
    from flowloom.operators.alerts import numbered

    rows = numbered(alerts).withColumn("seq", F.col("seq") + F.lit(first))
    made = rows.join(chain(rows, [], F.col(document), "seq", head), "seq")
    n = rows.count()
    if n:
        made.write.mode("errorifexists").parquet(f"{path}/from={first}")
    return n


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, through Spark's own file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def export_log(log: DataFrame, path: str, seq: str = "seq", versions: tuple[str, ...] = ()) -> dict:
    """The log under path: alerts.jsonl (lines in order, in files that follow each other), chain_head.txt, manifest.json and
    datasheet.md. Returns the manifest: records, first and last, version columns' values, the chain's head, and the digest of the lines.

    Refused if the chain is broken. Each file's lines are digested where they are, and their digests, in order, give the one of all.
    """
    from flowloom.operators.folds import GENESIS, inspect_chain
    from flowloom.staging import staged

    spark = log.sparkSession
    state = inspect_chain(log.withColumn("__log", F.lit(1)), ["__log"], F.col("document"), seq).first()
    if state is not None and not state.ok:
        raise ValueError(f"the chain is broken at record {state.first_bad}: {state.reason}")
    text = F.to_json(F.struct(*sorted(log.columns)))
    lines = staged(log.repartitionByRange(seq).sortWithinPartitions(seq).select(seq, text.alias("value"), F.spark_partition_id().alias("part")), "export")
    lines.repartitionByRange(seq).sortWithinPartitions(seq).select("value").write.mode("overwrite").text(f"{path}/alerts.jsonl")

    def make():
        h = hashlib.sha256()

        def step(value: str) -> tuple:
            h.update(value.encode() + b"\n")
            return (h.hexdigest(),)

        return step

    from flowloom.operators.ordered import fold_sorted

    each = fold_sorted(lines, ["part"], [seq], ["value"], make, "digest string").groupBy("part").agg(F.max_by("digest", seq).alias("digest"), F.min(seq).alias("first"))
    whole = hashlib.sha256("".join(r.digest for r in each.orderBy("first").collect()).encode()).hexdigest()
    facts = log.agg(F.count(F.lit(1)).alias("records"), F.min(seq).alias("first"), F.max(seq).alias("last"), *[F.array_sort(F.collect_set(v)).alias(v) for v in versions]).first()
    head = GENESIS if state is None else state.head
    manifest = {"records": facts.records, "first": facts.first, "last": facts.last, **{v: facts[v] for v in versions}, "sha256": whole, "chain_head": head, "chain_genesis": GENESIS}
    write_text(spark, f"{path}/chain_head.txt", head + "\n")
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=2) + "\n")
    write_text(spark, f"{path}/datasheet.md", "# Log export\n\n" + "".join(f"- {k}: {v}\n" for k, v in manifest.items()))
    return manifest


def bundle_manifest(members: dict[str, bytes], versions: dict[str, str]) -> str:
    """Names, sizes and sha256 of a model bundle's members, with the versions it was made for. Not signed."""
    return json.dumps({"members": {n: {"bytes": len(b), "sha256": hashlib.sha256(b).hexdigest()} for n, b in sorted(members.items())}, "versions": versions}, sort_keys=True)


def check_bundle(manifest: str, members: dict[str, bytes], versions: dict[str, str]) -> None:
    """Refuse a bundle whose members or versions are not those of its manifest."""
    spec = json.loads(manifest)
    if spec["versions"] != versions:
        raise ValueError(f"made for {spec['versions']}, this is {versions}")
    if json.loads(bundle_manifest(members, versions))["members"] != spec["members"]:
        raise ValueError("a member is not the one of the manifest")
