"""Detection rules as predicates over features, thresholds as data; suppression, fusion and severity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.folds import suppress

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

#: Detector, class, severity, confidence and thresholds of each rule on packet captures.
RULESET = {
    "RULE_DDOS_SYN_FLOOD": {"detector": "ddos_volume_detector", "class": "THREAT_DDOS_VOLUME", "severity": "CRITICAL", "confidence": 0.9, "srcs": 200, "entropy": 5.0, "syn_only": 0.8},
    "RULE_DDOS_UDP_REFLECTION": {"detector": "ddos_volume_detector", "class": "THREAT_DDOS_VOLUME", "severity": "CRITICAL", "confidence": 0.9, "flows": 50, "mean_pkt": 400.0, "bytes": 1_000_000},
    "RULE_DDOS_VOLUME_BASELINE": {"detector": "ddos_volume_detector", "class": "THREAT_DDOS_VOLUME", "severity": "HIGH", "confidence": 0.8, "ratio": 100.0, "srcs": 10, "bytes": 10_000_000, "flows": 100},
    "RULE_C2_PERIODIC_FLOWS": {"detector": "c2_beacon_detector", "class": "THREAT_C2_BEACON", "severity": "HIGH", "confidence": 0.8, "gaps": 16, "cv": 0.4, "period": 10.0, "periodic_dsts": 10},
    "RULE_DGA_NXDOMAIN_HIGH_ENTROPY": {"detector": "dga_lexical_detector", "class": "THREAT_DNS_DGA", "severity": "HIGH", "confidence": 0.9, "names": 20, "nxdomain": 0.5},
    "RULE_DGA_HIGH_ENTROPY_QNAMES": {"detector": "dga_lexical_detector", "class": "THREAT_DNS_DGA", "severity": "MEDIUM", "confidence": 0.6, "names": 20},
    "RULE_DNS_TUNNEL_VOLUME_LENGTH": {"detector": "dns_tunnel_detector", "class": "THREAT_DNS_TUNNEL", "severity": "HIGH", "confidence": 0.85, "queries": 50, "mean_length": 40.0},
    "RULE_TLS_KNOWN_BAD_JA4": {"detector": "encrypted_anomaly_detector", "class": "THREAT_ENCRYPTED_ANOMALY", "severity": "HIGH", "confidence": 0.95},
    "RULE_TLS_RARE_JA4_REPEATED": {"detector": "encrypted_anomaly_detector", "class": "THREAT_ENCRYPTED_ANOMALY", "severity": "MEDIUM", "confidence": 0.65, "others": 2, "pair_flows": 5, "bytes": 8192, "duration": 10.0},
    "RULE_RECON_FANOUT_SYN_ONLY": {"detector": "recon_portscan_detector", "class": "THREAT_RECON_PORTSCAN", "severity": "MEDIUM", "confidence": 0.8, "fanout": 20, "syn_only": 0.8, "fan_in": 5},
    "RULE_EXFIL_OUTBOUND_RATIO": {"detector": "exfiltration_detector", "class": "THREAT_EXFILTRATION", "severity": "HIGH", "confidence": 0.85, "egress": 1_000_000, "ratio": 50.0},
    "RULE_EXFIL_EGRESS_BASELINE": {"detector": "exfiltration_detector", "class": "THREAT_EXFILTRATION", "severity": "MEDIUM", "confidence": 0.75, "z": 3.0, "dst_srcs": 1},
}

EVIDENCE = "array<struct<feature:string,value:double,said:string,baseline:double,baseline_source:string,contribution:double>>"
SUBSTITUTIONS = "array<struct<unavailable:string,reason:string,substituted_by:array<string>>>"


def finite(c: Column) -> Column:
    """What is not a finite number becomes 0; null stays."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def evidence(feature: str, value: Column | None = None, baseline: Column | float | None = None, source: str | None = None, said: Column | None = None) -> Column:
    """A row of evidence: a feature, what it was (value, or said for texts), and what it was held against."""
    number = lambda c: F.lit(None).cast("double") if c is None else finite(c if isinstance(c, Column) else F.lit(float(c)))
    return F.struct(F.lit(feature).alias("feature"), number(value).alias("value"), (F.lit(None).cast("string") if said is None else said).alias("said"), number(baseline).alias("baseline"), F.lit(source).cast("string").alias("baseline_source"), F.lit(None).cast("double").alias("contribution"))


def over(feature: str, bound: float) -> Column:
    """Evidence of a column that was held against a threshold of the rule."""
    return evidence(feature, F.col(feature), bound, "rule_threshold")


@dataclass(frozen=True)
class Rule:
    """A predicate over feature columns, what its hits say, whose they are, and what speaks for them."""

    name: str
    when: Column
    detector: str
    severity: Column | str
    confidence: Column | float
    entity: Column
    evidence: tuple[Column, ...] = ()
    substitution: Column | None = None


def at_least(col: str, bound: float) -> Column:
    """Null never passes."""
    return F.coalesce(F.col(col) >= bound, F.lit(False))


def apply_rules(features: DataFrame, rules: list[Rule], keep: list[str], explain: bool = False) -> DataFrame:
    """A row per hit: the columns of keep, detector, rule, severity, confidence, entity; with explain, evidence and substitutions too.
    One pass over the features; of a detector's rules, the first in order that holds."""
    hits = []
    seen: dict[str, Column] = {}
    for r in rules:
        free = ~seen[r.detector] if r.detector in seen else F.lit(True)
        severity = F.lit(r.severity) if isinstance(r.severity, str) else r.severity
        confidence = r.confidence if isinstance(r.confidence, Column) else F.lit(r.confidence)
        said = [F.lit(r.detector).alias("detector"), F.lit(r.name).alias("rule"), severity.alias("severity"), confidence.alias("confidence"), r.entity.cast("string").alias("entity")]
        if explain:
            instead = F.array() if r.substitution is None else F.array(r.substitution)
            said += [F.array(*r.evidence).cast(EVIDENCE).alias("evidence"), instead.cast(SUBSTITUTIONS).alias("substitutions")]
        hits.append(F.when(free & r.when, F.struct(*said)))
        seen[r.detector] = seen[r.detector] | r.when if r.detector in seen else r.when
    return features.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(*keep, "hit.*")


def dedupe(hits: DataFrame, quiet: float, time: str, seq: str) -> DataFrame:
    """One hit per detector and entity in `quiet` after the last kept one; hits without an entity all stay."""
    named = hits.filter("entity is not null")
    return suppress(named, ["detector", "entity"], quiet, time, seq).unionByName(hits.filter("entity is null"))


def severity_rank(severity: str | Column) -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


def fuse(hits: DataFrame, by: list[str]) -> DataFrame:
    """Hits of one flow and class as one alert: all rules, highest severity and confidence; if the hits have them, the detector and
    entity of the first rule, and the evidence and substitutions of all, in order of their rules."""
    more = []
    if "evidence" in hits.columns:
        told = F.array_sort(F.collect_list(F.struct("rule", "detector", "entity", "evidence", "substitutions")))
        more = [told.alias("__told")]
    out = hits.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"), severity_name(F.max(severity_rank("severity"))).alias("severity"), F.max("confidence").alias("confidence"), *more)
    if more:
        all_of = lambda name: F.flatten(F.transform("__told", lambda t: t[name]))
        out = out.withColumns({"detector": F.col("__told")[0]["detector"], "entity": F.col("__told")[0]["entity"], "evidence": all_of("evidence"), "substitutions": all_of("substitutions")}).drop("__told")
    return out


def agree(alerts: DataFrame, scores: DataFrame, on: str, flag: float, alone: bool = False) -> DataFrame:
    """Alerts with a model's score: where it flags too, confidence is the higher and severity one step up. With alone, flagged rows
    without an alert become alerts of at most MEDIUM."""
    joined = alerts.join(scores, on, "full" if alone else "left").filter(F.col("severity").isNotNull() | (F.coalesce(F.col("score"), F.lit(0.0)) > flag))
    flagged = F.coalesce(F.col("score") > flag, F.lit(False))
    rank = F.when(F.col("severity").isNull(), F.lit(2)).otherwise(F.least(severity_rank("severity") + flagged.cast("int"), F.lit(4)))
    confidence = F.when(flagged, F.greatest(F.coalesce(F.col("confidence"), F.lit(0.0)), F.col("score"))).otherwise(F.col("confidence"))
    return joined.withColumns({"severity": severity_name(rank), "confidence": F.round(F.least(confidence, F.lit(1.0)), 4)})


def split_evidence(rows: Column, contract: set[str]) -> Column:
    """Evidence rows (see evidence()) in two: those of contract features stay rows; the values of all, by name, are the metrics."""
    known = F.array(*[F.lit(n) for n in sorted(contract)])
    numbers = F.filter(rows, lambda r: r["value"].isNotNull())
    # of a feature that several rules tell, the last one's value counts
    latest = F.map_from_entries(F.transform(F.array_distinct(F.transform(numbers, lambda r: r["feature"])), lambda n: F.struct(n.alias("key"), F.element_at(F.filter(numbers, lambda r: r["feature"] == n), -1)["value"].alias("value"))))
    return F.struct(F.filter(rows, lambda r: F.array_contains(known, r["feature"])).alias("evidence"), latest.alias("metrics"))
