"""Alerts as records: fused hits with their evidence, flows, model scores, window ids, and the fast lane's provisional ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.operators import folds, sketches
from flowloom.operators.contract import Contract
from flowloom.operators.rules import EVIDENCE, SUBSTITUTIONS, severity_name, severity_rank, split_evidence
from flowloom.staging import staged

RULESET_VERSION, MODEL_VERSION, SCHEMA_VERSION = "2.1.0", "1", 2
#: Detectors whose hits name a destination or a source rather than one flow.
AGGREGATE = {"ddos_volume_detector": "dst", "recon_portscan_detector": "src", "dga_lexical_detector": "src", "dns_tunnel_detector": "src"}
#: The flow lane's detector that confirms what the fast lane says of a class.
CONFIRMED_BY = {"THREAT_DDOS_VOLUME": "ddos_volume_detector", "THREAT_RECON_PORTSCAN": "recon_portscan_detector"}


def window_id(scope: Column, entity: Column, start: Column, length: float) -> Column:
    return F.concat_ws(":", F.lit("win"), scope, entity, F.floor(start).cast("long").cast("string"), F.lit(str(int(length))))


def iso(seconds: Column) -> Column:
    """Seconds since 1970 as a time with its zone, whatever the session's zone."""
    whole = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.round(seconds, 6).cast("decimal(18,6)"))
    return F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def alert_id(*parts: str) -> Column:
    return F.concat(F.lit("alert-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def _scored(scores: DataFrame) -> DataFrame:
    """Per flow what flags it: all probabilities, the highest, the first model's contributions."""
    told = F.array_sort(F.collect_list(F.struct("model", "probability", "contributions")))
    per = scores.filter("flagged").groupBy("ord").agg(told.alias("__m"))
    return per.select("ord", F.transform("__m", lambda m: F.round(m["probability"], 4)).alias("ml_scores"), F.array_max(F.transform("__m", lambda m: m["probability"])).alias("__top"), F.col("__m")[0]["contributions"].alias("__why"))


def assemble(fused: DataFrame, flows: DataFrame, window: float, scores: DataFrame | None = None, gate: bool = True) -> DataFrame:
    """Alerts of fused hits (rules.fuse() by flow and class) as records.

    flows: ord, flow_id, dst_ip, src_ip, last_time, total_packets, total_bytes, pps, bps. scores: ord, model, ml_class, probability, score,
    flagged, alone and contributions (rows of evidence). Where a model flags an alert's flow, its scores are attached; with gate, the
    confidence becomes the higher one, the severity one step more, and the contributions join the evidence. With gate, a flagged flow
    without any alert becomes one by itself, of MEDIUM at most, if the model may do so (alone). Detectors that name an entity give
    alerts of a window, with the flows that brought it about; others name their flow. Numbers that are not finite become 0.
    """
    contract = Contract.load()
    base = fused.withColumns({"detector_type": F.lit("RULE"), "ml_scores": F.array().cast("array<double>"), "rule_matches": F.split("rules", ",")})
    if scores is not None:
        flags = _scored(scores)
        met = base.drop("ml_scores").join(flags, "ord", "left")
        hit = F.col("ml_scores").isNotNull()
        base = met.withColumns({"ml_scores": F.coalesce("ml_scores", F.array().cast("array<double>")), "detector_type": F.when(hit, "HYBRID_RULE_ML").otherwise("RULE")})
        if gate:
            more = {
                "confidence": F.when(hit, F.least(F.lit(1.0), F.greatest("confidence", "__top"))).otherwise(F.col("confidence")),
                "severity": F.when(hit, severity_name(F.least(severity_rank("severity") + 1, F.lit(4)))).otherwise(F.col("severity")),
                "evidence": F.when(hit, F.concat("evidence", F.coalesce(F.col("__why").cast(EVIDENCE), F.array().cast(EVIDENCE)))).otherwise(F.col("evidence")),
            }
            base = base.withColumns(more)
        base = base.drop("__top", "__why")
        if gate:
            said = F.when(F.col("probability") >= 0.8, "HIGH").when(F.col("probability") >= 0.5, "MEDIUM").otherwise("LOW")
            alone = scores.filter("flagged and alone").join(fused.select("ord"), "ord", "left_anti").join(flows.select(*[c for c in fused.columns if c in flows.columns]), "ord")
            own = {
                "threat_class": F.col("ml_class"), "rules": F.lit(""), "rule_matches": F.array().cast("array<string>"), "detector_type": F.lit("ML"), "detector": F.col("model"), "entity": F.lit(None).cast("string"),
                "severity": severity_name(F.least(severity_rank(said), F.lit(2))), "confidence": F.col("probability"), "ml_scores": F.array(F.round("probability", 4)), "evidence": F.col("contributions").cast(EVIDENCE), "substitutions": F.array().cast(SUBSTITUTIONS),
            }
            base = base.unionByName(alone.withColumns(own).select(*base.columns))
    scopes = F.create_map(*[F.lit(x) for kv in AGGREGATE.items() for x in kv])
    scope = F.when(F.col("entity").isNotNull(), F.try_element_at(scopes, F.col("detector")))
    told = split_evidence(F.col("evidence"), set(contract.features))
    numbers = flows.select("ord", *[F.coalesce(F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), F.lit(0.0)).otherwise(F.col(c).cast("double")), F.lit(0.0)).alias(f"__{c}") for c in ("total_packets", "total_bytes", "pps", "bps")])
    out = base.join(numbers, "ord").withColumns({"scope": scope, "__told": told, "trigger": F.col("flow_id"), "aid": F.xxhash64(F.col("ord").cast("string"), "threat_class", "detector")})
    out = staged(out, "alert-rows")
    # the flows that brought an aggregate alert about: few alerts meet the flows of their windows
    listed = None
    for name in ("dst", "src"):
        mine = out.filter(F.col("scope") == name).select("aid", F.col("entity").alias(f"{name}_ip"), "ord", "last_time", F.col("trigger").alias("flow_id"))
        got = sketches.contributing_flows(mine, flows, f"{name}_ip", "total_bytes", "last_time", window, "flow_id").select("aid", "contributing")
        listed = got if listed is None else listed.unionByName(got)
    out = out.join(listed, "aid", "left")
    start = F.floor(F.col("last_time") / window) * window
    models = {"RULE": f"rules-{RULESET_VERSION}", "ML": f"ml-{MODEL_VERSION}", "HYBRID_RULE_ML": f"rules-{RULESET_VERSION}+ml-{MODEL_VERSION}"}
    versions = F.create_map(*[F.lit(x) for kv in models.items() for x in kv])
    return out.select(
        alert_id("trigger", "last_time", "threat_class", "detector").alias("alert_id"), F.col("last_time").alias("ts"), iso(F.col("last_time")).alias("timestamp"), "threat_class", "severity",
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))), 4).alias("confidence"),
        F.struct(F.col("detector").alias("name"), F.col("detector_type").alias("type"), F.when(F.col("detector_type") == "ML", F.lit(MODEL_VERSION)).otherwise(F.lit(RULESET_VERSION)).alias("version")).alias("detector"),
        F.struct("src_ip", "src_port", "dst_ip", "dst_port", "protocol", iso(F.col("start_time")).alias("window_start"), iso(F.col("last_time")).alias("window_end")).alias("flow"),
        "rule_matches", "ml_scores", F.col("__told.metrics").alias("metrics"), F.col("__told.evidence").alias("evidence"), "substitutions", "entity",
        F.struct(F.col("__total_packets").cast("long").alias("total_packets"), F.col("__total_bytes").cast("long").alias("total_bytes"), F.round("__pps", 2).alias("pps"), F.round("__bps", 2).alias("bps")).alias("feature_summary"),
        F.when(F.col("scope").isNotNull(), window_id(F.col("scope"), F.col("entity"), start, window)).otherwise(F.col("trigger")).alias("flow_id"), F.col("contributing").alias("contributing_flows"), "trigger",
        "observability_state", F.lit(False).alias("provisional"), F.lit(contract.version).alias("contract_version"), F.element_at(versions, F.col("detector_type")).alias("model_version"), F.lit(SCHEMA_VERSION).alias("schema_version"), "ord",
    )


def unreported(hits: DataFrame, fired: DataFrame, on: list[str], keys: list[str], time: str, seq: str, quiet: float) -> DataFrame:
    """hits but those less than `quiet` after a row of fired (on, time and fired, its time) with the same `on`, and of what is left, per
    keys, those at least `quiet` after the last one kept."""
    free = folds.as_of(hits, fired, on, time, "fired", quiet).filter("fired is null").drop("fired")
    return folds.suppress(free, keys, quiet, time, seq)


def provisional(fast: DataFrame, kept: DataFrame, quiet: float) -> DataFrame:
    """Provisional alerts of the fast lane's hits (fastlane.capture_hits()): one per class and entity in `quiet` seconds, and none
    within `quiet` of a flow alert that the confirming detector gave on that entity. kept: the flow lane's hits (detector, entity,
    last_time) after suppression."""
    by = F.create_map(*[F.lit(x) for kv in CONFIRMED_BY.items() for x in kv])
    hits = fast.withColumns({"t": F.col("w") + 1.0, "confirmed_by": F.try_element_at(by, F.col("threat_class"))})
    fired = kept.filter("entity is not null").select(F.col("detector").alias("confirmed_by"), "entity", F.col("last_time").alias("t"), F.col("last_time").alias("fired"))
    numbered = hits.withColumn("no", F.xxhash64("rule", "w"))
    raised = unreported(numbered, fired, ["confirmed_by", "entity"], ["threat_class", "entity"], "t", "no", quiet).drop("no", "confirmed_by")
    told = split_evidence(F.col("evidence"), set(Contract.load().features))
    first = F.col("contributors")[0]
    return raised.select(
        alert_id("rule", "entity", "w").alias("alert_id"), F.col("t").alias("ts"), iso(F.col("t")).alias("timestamp"), "threat_class", "severity", F.round("confidence", 4).alias("confidence"),
        F.struct(F.lit("fastlane_detector").alias("name"), F.lit("RULE").alias("type"), F.lit(RULESET_VERSION).alias("version")).alias("detector"),
        F.struct(first["src"].alias("src_ip"), first["sport"].alias("src_port"), first["dst"].alias("dst_ip"), first["dport"].alias("dst_port"), first["protocol"].alias("protocol"), iso(F.col("w").cast("double")).alias("window_start"), iso(F.col("t")).alias("window_end")).alias("flow"),
        F.array("rule").alias("rule_matches"), F.array().cast("array<double>").alias("ml_scores"), told["metrics"].alias("metrics"), told["evidence"].alias("evidence"), F.array().cast(SUBSTITUTIONS).alias("substitutions"), "entity",
        F.struct(F.col("packets").cast("long").alias("total_packets"), F.lit(0).cast("long").alias("total_bytes"), F.col("packets").cast("double").alias("pps"), F.lit(0.0).alias("bps")).alias("feature_summary"),
        window_id(F.col("scope"), F.col("entity"), F.col("w"), 1.0).alias("flow_id"), F.transform("contributors", lambda c: c["flow_id"]).alias("contributing_flows"),
        F.lit(True).alias("provisional"), F.lit(Contract.load().version).alias("contract_version"), F.lit(f"rules-{RULESET_VERSION}").alias("model_version"), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def confirm(alerts: DataFrame, provisional_: DataFrame, quiet: float) -> DataFrame:
    """alerts with confirms: the provisional alert of the same class and entity less than `quiet` seconds before."""
    # a window's hit may carry a time up to a second past the packets that made it
    named = provisional_.select("threat_class", "entity", (F.col("ts") - 1.0).alias("ts"), F.col("alert_id").alias("confirms"))
    return folds.as_of(alerts, named, ["threat_class", "entity"], "ts", "confirms", quiet)


def numbered(alerts: DataFrame) -> DataFrame:
    """With seq, from 0 in order of time and id. Alerts are few beside flows, but they are numbered without one common sort: by the
    counts of time ranges first."""
    ranged = staged(alerts.repartitionByRange("ts", "alert_id").sortWithinPartitions("ts", "alert_id").withColumn("__part", F.spark_partition_id()), "alert-order")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy("ts", "alert_id")) - 1
    return ranged.join(F.broadcast(before), "__part").withColumn("seq", (F.col("__before") + place).cast("long")).drop("__part", "__before")
