"""From packets to alerts: flows, features as of each flow, rules, suppression, fusion, alerts as records, campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.functions import network, text
from flowloom.operators import alerts as al
from flowloom.operators import correlate, fastlane, folds, rollups, sketches, tier1
from flowloom.operators import flows as fl
from flowloom.operators.contract import Contract
from flowloom.operators.rules import RULESET, Rule, apply_rules, at_least, dedupe, evidence, fuse, over
from flowloom.staging import staged

WINDOW, MINUTE = 60.0, 60.0
HIGH_ENTROPY = 3.5
#: What of a flow its alerts are told with.
FLOW = ["ord", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_time", "last_time", "observability_state"]


def describe_flows(flows: DataFrame, internal: tuple[str, ...] = network.INTERNAL) -> DataFrame:
    """Assembled flows with their order, id, fields, direction, handshake, DNS client and first fingerprints. What a half that was not
    captured would tell is null, with *_available to tell it from what is undefined."""
    inside_src, inside_dst = (F.coalesce(network.in_networks(c, internal), F.lit(False)) for c in ("src_ip", "dst_ip"))
    both = F.col("reverse_seen")
    icmp = F.col("protocol").isin("ICMP", "ICMPv6")
    f = tier1.flow_fields(flows).withColumns(
        {
            "ord": F.struct("last_time", "start_time", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "chunk", "session"),
            "way": network.direction(inside_src, inside_dst),
            "id_a": F.when(icmp, F.col("icmp_type")).otherwise(F.col("src_port")),
            "id_b": F.when(icmp, F.col("icmp_code")).otherwise(F.col("dst_port")),
            "syn_only": (F.col("protocol") == "TCP") & (F.col("fwd_tcp_flags").bitwiseAND(18) == 2),
            "handshake_available": both & (F.col("protocol") == "TCP"),
            "tcp_handshake_completed": F.when(both & (F.col("protocol") == "TCP"), F.col("syn_ts").isNotNull() & F.col("synack_ts").isNotNull() & (F.col("syn_rev") != F.col("synack_rev"))),
            **{f"first_{c}": F.try_element_at(f"tls_{c}", F.lit(1)) for c in ("ja3", "ja4", "ja3s")},
            "client": F.when(F.col("fwd_is_responder"), F.col("dst_ip")).otherwise(F.col("src_ip")),
            "responder_seen": F.when(F.col("fwd_is_responder"), F.col("fwd_packets") > 0).otherwise(F.col("rev_packets") > 0),
        }
    )
    forward, udp = F.col("src_port").isin(*network.REFLECTOR_PORTS), F.col("protocol") == "UDP"
    backward = ~forward & F.col("dst_port").isin(*network.REFLECTOR_PORTS)
    toward, asked = F.when(forward, F.col("fwd_packets")).otherwise(F.col("rev_packets")), F.when(forward, F.col("rev_packets")).otherwise(F.col("fwd_packets"))
    reflected = udp & (forward | backward) & (asked == 0) & (toward > 0)
    return f.withColumns(
        {
            "flow_id": network.community_id("protocol", "src_ip", "dst_ip", "id_a", "id_b"),
            "egress_bytes": network.egress_bytes(F.col("way"), F.col("fwd_bytes"), F.col("rev_bytes")).cast("double"),
            "host": F.when(F.col("way") == "outbound", F.col("src_ip")).when(F.col("way") == "inbound", F.col("dst_ip")),
            "external": F.when(F.col("way").isin("outbound", "internal"), F.col("dst_ip")).otherwise(F.col("src_ip")),
            "tcp_rtt": F.when(F.col("tcp_handshake_completed"), F.greatest(F.col("synack_ts") - F.col("syn_ts"), F.lit(0.0))),
            "ratio_available": both,
            "outbound_inbound_byte_ratio": F.when(both, network.byte_ratio(F.col("way"), F.col("fwd_bytes"), F.col("rev_bytes"))),
            "tls_client_server_fp_pair": F.when(both & F.col("first_ja4").isNotNull() & F.col("first_ja3s").isNotNull(), F.concat_ws("|", "first_ja4", "first_ja3s")),
            "dns_nxdomain_rate": F.when(F.col("responder_seen"), F.try_divide("dns_nxdomain", "dns_responses")),
            # the end that a reflector's answers went to without its having asked
            "victim": F.when(reflected, F.when(forward, F.col("dst_ip")).otherwise(F.col("src_ip"))),
            "victim_bytes": F.when(reflected, F.when(forward, F.col("fwd_bytes")).otherwise(F.col("rev_bytes"))),
            "victim_packets": F.when(reflected, toward),
            "off_hours": network.off_hours(F.timestamp_seconds("last_time").cast("timestamp_ntz")),
        }
    )


def _dns(f: DataFrame) -> DataFrame:
    """Per flow with names: what its client asked in the window, by name."""
    names = f.filter(F.size("dns_queries") > 0).select("ord", "client", "last_time", F.explode("dns_queries").alias("name"))
    high = (text.entropy(text.first_label("name")) >= HIGH_ENTROPY).cast("long")
    marked = names.withColumns({"high": high, "by": F.struct("ord", "name")})
    sums = {"src_dns_queries_w": F.lit(1), "src_high_entropy_qnames_w": F.col("high"), "src_qname_len_sum_w": F.length("name")}
    run = rollups.running_all(marked, ["client"], sums, {"src_distinct_qnames_w": "name"}, time="last_time", width=WINDOW, order="by")
    return run.groupBy("ord").agg(*[F.max(c).alias(c) for c in (*sums, "src_distinct_qnames_w")])


def _egress(f: DataFrame) -> DataFrame:
    """Per flow of an inside host: bytes out in the last 1, 5 and 60 minutes and the open minute's deviation from its baseline."""
    own = f.filter("host is not null").select("ord", "host", "last_time", "egress_bytes")
    sums = rollups.bucket_sums(own, "host", "egress_bytes", {"src_egress_bytes_1m": 1, "src_egress_bytes_5m": 5, "src_egress_bytes_1h": 60}, "last_time", MINUTE)
    minute = F.floor(F.col("last_time") / MINUTE).cast("long")
    per = own.groupBy("host", minute.alias("b")).agg(F.sum("egress_bytes").alias("v"))
    base = folds.ewma_baseline(per, "host", "b", ["v"]).select("host", "b", "v_mean", "v_var", "closed")
    z = (F.col("src_egress_bytes_1m") - F.col("v_mean")) / F.greatest(F.sqrt("v_var"), 0.1 * F.col("v_mean"), F.lit(1.0))
    return sums.withColumn("b", minute).join(base, ["host", "b"]).select("ord", "src_egress_bytes_1m", "src_egress_bytes_5m", "src_egress_bytes_1h", F.when(F.col("closed") >= 5, z).alias("src_egress_bytes_z"))


def _baseline(f: DataFrame) -> DataFrame:
    """Per destination and window: the smoothed flows and bytes of the windows before."""
    wid = F.floor(F.col("last_time") / WINDOW).cast("long")
    per = f.groupBy("dst_ip", wid.alias("b")).agg(F.count(F.lit(1)).cast("double").alias("flows"), F.sum(F.col("total_bytes").cast("double")).alias("bytes"))
    return folds.ewma_baseline(per, "dst_ip", "b", ["flows", "bytes"]).select("dst_ip", "b", "flows_mean", "bytes_mean", F.col("closed").alias("dst_closed"))


def reflection(f: DataFrame, order: str = "ord", time: str = "last_time", width: float = WINDOW) -> DataFrame:
    """order, end (dst or src) and what reflectors sent to that end in the window and the one before, as of the flow: flows, bytes,
    mean packet. f: order, time, src_ip, dst_ip, victim, victim_bytes, victim_packets. Rows of ends that never were a victim are
    left out, so that few rows take part."""
    ends = F.explode(F.array(F.struct(F.lit("dst").alias("end"), F.col("dst_ip").alias("ip")), F.struct(F.lit("src").alias("end"), F.col("src_ip").alias("ip")))).alias("e")
    seen = f.select(order, time, (F.col("src_ip") == F.col("dst_ip")).alias("alone"), "victim", "victim_bytes", "victim_packets", ends).select("*", "e.end", "e.ip").drop("e")
    rows = seen.join(f.filter("victim is not null").select(F.col("victim").alias("ip")).distinct(), "ip", "left_semi").withColumn("by", F.struct(order, "end"))
    # a flow counts for its victim once, though both its ends may be that
    mine = F.coalesce(F.col("victim") == F.col("ip"), F.lit(False)) & ((F.col("end") == "dst") | ~F.col("alone"))
    hit = mine.cast("long")
    run = rollups.running_sums(rows, ["ip"], {"reflector_flows": hit, "reflector_bytes": F.when(mine, F.col("victim_bytes")).otherwise(0), "reflector_packets": F.when(mine, F.col("victim_packets")).otherwise(0)}, time, width, "by")
    return run.select(order, "end", "reflector_flows", "reflector_bytes", F.try_divide("reflector_bytes", "reflector_packets").alias("reflector_mean_pkt"))


def features(flows: DataFrame) -> DataFrame:
    """describe_flows() with the windowed features of both ends, the pair, the DNS client and the link, each as of the flow.

    What windows need of a flow is little; it is cut out first, and meets the rest again at the end."""
    keep = ["ord", "src_ip", "dst_ip", "dst_port", "protocol", "first_ja4", "client", "host", "external", "start_time", "last_time", "total_bytes", "syn_only", "is_tcp", "responder_seen", "dns_queries", "dns_responses", "dns_nxdomain", "egress_bytes", "reverse_seen", "victim", "victim_bytes", "victim_packets"]
    slim = flows.select(*keep)
    f = rollups.periodicity(slim.withColumn("dns_n", F.size("dns_queries")).drop("dns_queries", "host", "egress_bytes", "victim", "victim_bytes", "victim_packets"), ["src_ip", "dst_ip"], "start_time")
    f = f.withColumn("periodic_dst", F.when((F.col("iat_n") >= 3) & (F.col("iat_cv") <= 0.35), F.col("dst_ip")))
    one, tcp, syn = F.lit(1), F.col("is_tcp").cast("long"), F.col("syn_only").cast("long")
    f = rollups.running_all(f, ["src_ip"], {"src_flows_w": one, "src_syn": syn, "src_tcp": tcp}, {"src_distinct_dsts_w": "dst_ip", "src_distinct_dst_ports_w": "dst_port", "src_distinct_ja4_w": "first_ja4", "src_periodic_dsts_w": "periodic_dst"}, time="last_time", width=WINDOW)
    f = staged(f, "sources")
    f = rollups.running_all(f, ["dst_ip"], {"dst_flows_w": one, "dst_bytes_w": F.col("total_bytes"), "dst_syn": syn, "dst_tcp": tcp}, {"dst_distinct_srcs_w": "src_ip"}, {"dst_src_ip_entropy_w": "src_ip"}, time="last_time", width=WINDOW)
    f = rollups.longterm_distinct(f, ["dst_ip"], "src_ip", "dst_distinct_srcs_longterm")
    f = rollups.running_sums(f, ["src_ip", "dst_ip"], {"pair_flows_w": one}, "last_time", WINDOW)
    f = rollups.running_count(rollups.running_count(f, ["src_ip", "dst_ip"], "pair_history_count"), ["first_ja4"], "ja4_prevalence")
    answers = F.when(F.col("responder_seen") & ((F.col("dns_n") > 0) | (F.col("dns_responses") > 0)), 1).otherwise(0)
    seen = lambda c: F.when(F.col("responder_seen"), F.col(c)).otherwise(0)
    f = rollups.running_sums(f, ["client"], {"answered": answers, "responses": seen("dns_responses"), "nxdomain": seen("dns_nxdomain")}, "last_time", WINDOW)
    wid = F.floor(F.col("last_time") / WINDOW).cast("long")
    here = Window.partitionBy("dst_ip", "b").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("b", wid).withColumns({"n_now": F.count(F.lit(1)).over(here), "bytes_now": F.sum("total_bytes").over(here)})
    f = rollups.link_visibility(f, "reverse_seen", "last_time", WINDOW).withColumnRenamed("link_visibility", "link_reverse_visibility_w")
    f = staged(f, "tiers")
    # what the far end of a flow from outside has been called by: it is that flow's source
    calls = f.select(F.col("dst_ip").alias("ip"), "ord", F.col("dst_distinct_srcs_longterm").alias("n"))
    far = rollups.probe(calls, f.filter("external <> dst_ip").select(F.col("external").alias("ip"), "ord"), ["ip"]).select("ord", F.coalesce("n", F.lit(0)).alias("far_srcs"))
    refl = staged(reflection(slim), "reflection")
    end = lambda e, name: refl.filter(F.col("end") == e).select("ord", *[F.col(f"reflector_{c}").alias(f"{name}_{c}{s}") for c, s in (("flows", "_w"), ("bytes", "_w"), ("mean_pkt", "_w"))])
    f = f.join(_baseline(f), ["dst_ip", "b"], "left").join(_dns(slim), "ord", "left").join(_egress(slim), "ord", "left").join(far, "ord", "left").join(end("dst", "dst_reflector"), "ord", "left").join(end("src", "src_reflector"), "ord", "left")
    warm = F.col("dst_closed") >= 5
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("src_dns_queries_w", "src_high_entropy_qnames_w", "src_qname_len_sum_w", "src_distinct_qnames_w", *(f"{e}_reflector_{c}_w" for e in ("dst", "src") for c in ("flows", "bytes")))}
    made = f.withColumns(
        {
            "src_syn_only_ratio_w": F.try_divide("src_syn", "src_tcp"), "dst_syn_only_ratio_w": F.try_divide("dst_syn", "dst_tcp"),
            "dst_bytes_vs_baseline": F.when(warm, F.col("bytes_now") / F.greatest("bytes_mean", F.lit(1.0))), "dst_flows_vs_baseline": F.when(warm, F.col("n_now") / F.greatest("flows_mean", F.lit(1.0))),
            "src_nxdomain_rate_w": F.when(F.col("answered") > 0, F.try_divide("nxdomain", "responses")), "mean_qname_len": F.try_divide("src_qname_len_sum_w", "src_dns_queries_w"),
            "external_srcs_longterm": F.coalesce("far_srcs", "dst_distinct_srcs_longterm"), "pair_iat_n": F.col("iat_n"), "pair_iat_mean": F.col("iat_mean"), "pair_iat_cv": F.col("iat_cv"), **zero,
        }
    )
    new = [c for c in made.columns if c not in flows.columns and c not in ("iat_n", "iat_mean", "iat_cv", "b", "periodic_dst", "dns_n", "far_srcs")]
    return flows.join(made.select("ord", *new), "ord")


def ruleset(thresholds: dict = RULESET, pollers: tuple[str, ...] = (), bad_ja4: tuple[str, ...] = ()) -> list[Rule]:
    """The rules as predicates, thresholds as data; of one detector, the first that holds. bad_ja4: with known_bad() for lists of any
    length, a few literals here."""
    made = []
    c, t, null = F.col, thresholds, F.lit(None)

    def add(name: str, when: Column, entity: Column, told: list[Column], severity: Column | None = None, confidence: Column | None = None, instead: Column | None = None) -> None:
        r = t[name]
        made.append(Rule(name, F.coalesce(when, F.lit(False)), r["detector"], r["severity"] if severity is None else severity, r["confidence"] if confidence is None else confidence, entity, tuple(told), instead))

    def substitution(feature: str, reason: Column) -> Column:
        by = Contract.load().features[feature].substitutes
        return F.struct(F.lit(feature).alias("unavailable"), reason.alias("reason"), F.array(*[F.lit(x) for x in by]).alias("substituted_by"))

    x = t["RULE_DDOS_SYN_FLOOD"]
    add("RULE_DDOS_SYN_FLOOD", at_least("dst_distinct_srcs_w", x["srcs"]) & at_least("dst_src_ip_entropy_w", x["entropy"]) & at_least("dst_syn_only_ratio_w", x["syn_only"]), c("dst_ip"), [over("dst_distinct_srcs_w", x["srcs"]), over("dst_src_ip_entropy_w", x["entropy"]), over("dst_syn_only_ratio_w", x["syn_only"])])
    x = t["RULE_DDOS_UDP_REFLECTION"]
    flooded = {e: at_least(f"{e}_reflector_flows_w", x["flows"]) & at_least(f"{e}_reflector_mean_pkt_w", x["mean_pkt"]) & at_least(f"{e}_reflector_bytes_w", x["bytes"]) for e in ("dst", "src")}
    at = lambda feature: F.when(flooded["dst"], c(f"dst_{feature}")).otherwise(c(f"src_{feature}"))
    told = [evidence(f"dst_{n}", at(n), b, "rule_threshold") for n, b in (("reflector_flows_w", x["flows"]), ("reflector_mean_pkt_w", x["mean_pkt"]), ("reflector_bytes_w", x["bytes"]))]
    add("RULE_DDOS_UDP_REFLECTION", flooded["dst"] | flooded["src"], F.when(flooded["dst"], c("dst_ip")).otherwise(c("src_ip")), told)
    x = t["RULE_DDOS_VOLUME_BASELINE"]
    far_above = at_least("dst_bytes_vs_baseline", x["ratio"]) | at_least("dst_flows_vs_baseline", x["ratio"])
    much = at_least("dst_bytes_w", x["bytes"]) | at_least("dst_flows_w", x["flows"])
    told = [evidence(n, c(n), 1.0, "dst_ewma") for n in ("dst_bytes_vs_baseline", "dst_flows_vs_baseline")] + [evidence(n, c(n)) for n in ("dst_bytes_w", "dst_flows_w", "dst_distinct_srcs_w")]
    add("RULE_DDOS_VOLUME_BASELINE", far_above & (c("dst_distinct_srcs_w") <= x["srcs"]) & much, c("dst_ip"), told)
    x = t["RULE_C2_PERIODIC_FLOWS"]
    listed = F.coalesce(network.in_networks("src_ip", pollers), F.lit(False)) if pollers else F.lit(False)
    told = [over("pair_iat_cv", x["cv"]), evidence("pair_iat_n", c("pair_iat_n")), over("pair_iat_mean", x["period"]), over("src_periodic_dsts_w", x["periodic_dsts"])]
    pair = F.concat_ws(">", "src_ip", "dst_ip")
    add("RULE_C2_PERIODIC_FLOWS", at_least("pair_iat_n", x["gaps"]) & (c("pair_iat_cv") <= x["cv"]) & at_least("pair_iat_mean", x["period"]) & ~listed & (c("src_periodic_dsts_w") < x["periodic_dsts"]), pair, told)
    x = t["RULE_DGA_NXDOMAIN_HIGH_ENTROPY"]
    many = (c("dns_query_count") > 0) & at_least("src_high_entropy_qnames_w", x["names"]) & at_least("src_distinct_qnames_w", x["names"])
    told = [over("src_high_entropy_qnames_w", x["names"]), evidence("src_distinct_qnames_w", c("src_distinct_qnames_w"))]
    add("RULE_DGA_NXDOMAIN_HIGH_ENTROPY", many & at_least("src_nxdomain_rate_w", x["nxdomain"]), c("client"), [*told, over("src_nxdomain_rate_w", x["nxdomain"])])
    add("RULE_DGA_HIGH_ENTROPY_QNAMES", many & (c("answered") == 0), c("client"), told, instead=substitution("src_nxdomain_rate_w", F.lit("no answers to this host were captured in the window")))
    x = t["RULE_DNS_TUNNEL_VOLUME_LENGTH"]
    told = [over("src_dns_queries_w", x["queries"]), evidence("mean_qname_len", F.round("mean_qname_len", 1), x["mean_length"], "rule_threshold")]
    add("RULE_DNS_TUNNEL_VOLUME_LENGTH", (c("dns_query_count") > 0) & at_least("src_dns_queries_w", x["queries"]) & at_least("mean_qname_len", x["mean_length"]), c("client"), told)
    ja4 = evidence("tls_ja4", said=c("first_ja4"))
    known = c("first_ja4").isin(*bad_ja4) if bad_ja4 else F.lit(False)
    add("RULE_TLS_KNOWN_BAD_JA4", known, pair, [ja4])
    x = t["RULE_TLS_RARE_JA4_REPEATED"]
    told = [ja4, evidence("ja4_prevalence", c("ja4_prevalence")), evidence("pair_history_count", c("pair_history_count")), over("pair_flows_w", x["pair_flows"]), over("total_bytes", x["bytes"]), over("duration", x["duration"])]
    add("RULE_TLS_RARE_JA4_REPEATED", c("first_ja4").isNotNull() & (c("ja4_prevalence") - c("pair_history_count") <= x["others"]) & at_least("pair_flows_w", x["pair_flows"]) & (c("total_bytes") <= x["bytes"]) & (c("duration") <= x["duration"]), pair, told)
    x = t["RULE_RECON_FANOUT_SYN_ONLY"]
    told = [over("src_distinct_dsts_w", x["fanout"]), over("src_distinct_dst_ports_w", x["fanout"]), over("src_syn_only_ratio_w", x["syn_only"])]
    add("RULE_RECON_FANOUT_SYN_ONLY", (c("is_tcp") > 0) & (F.greatest("src_distinct_dsts_w", "src_distinct_dst_ports_w") >= x["fanout"]) & at_least("src_syn_only_ratio_w", x["syn_only"]) & (c("dst_distinct_srcs_w") < x["fan_in"]), c("src_ip"), told)
    x = t["RULE_EXFIL_OUTBOUND_RATIO"]
    told = [over("outbound_inbound_byte_ratio", x["ratio"]), evidence("egress_bytes", c("egress_bytes"))]
    add("RULE_EXFIL_OUTBOUND_RATIO", c("ratio_available") & at_least("egress_bytes", x["egress"]) & at_least("outbound_inbound_byte_ratio", x["ratio"]), null, told)
    x = t["RULE_EXFIL_EGRESS_BASELINE"]
    told = [evidence("src_egress_bytes_z", c("src_egress_bytes_z"), 0.0, "host_ewma"), evidence("dst_distinct_srcs_longterm", c("external_srcs_longterm")), evidence("off_hours", c("off_hours").cast("double")), evidence("egress_bytes", c("egress_bytes"))]
    unseen = substitution("outbound_inbound_byte_ratio", F.concat(F.lit("the other half was not seen on this flow: "), c("observability_state")))
    hit = ~c("ratio_available") & (c("egress_bytes") > 0) & at_least("src_egress_bytes_z", x["z"]) & (c("external_srcs_longterm") <= x["dst_srcs"])
    add("RULE_EXFIL_EGRESS_BASELINE", hit, null, told, F.when(c("off_hours"), "HIGH").otherwise(x["severity"]), F.when(c("off_hours"), 0.85).otherwise(x["confidence"]), unseen)
    return made


def known_bad(features_: DataFrame, listed: DataFrame) -> DataFrame:
    """features with known_bad, if the first JA4 is among listed (item, of read_list()): a join, so the list may be long."""
    return features_.join(listed.select(F.col("item").alias("first_ja4"), F.lit(True).alias("__bad")).distinct(), "first_ja4", "left").withColumn("known_bad", F.coalesce("__bad", F.lit(False))).drop("__bad")


def flow_hits(f: DataFrame, rules: list[Rule] | None = None, quiet: float = 300.0) -> DataFrame:
    """Hits of the rules on features(), with what speaks for them; repeated hits of an entity are left out for `quiet` seconds after the
    last one kept."""
    hits = apply_rules(f, rules or ruleset(), FLOW, explain=True)
    numbered = hits.withColumn("hit_no", F.xxhash64(F.col("ord").cast("string"), "rule"))
    classes = F.create_map(*[F.lit(x) for name, r in RULESET.items() for x in (name, r["class"])])
    return dedupe(numbered, quiet, "last_time", "hit_no").drop("hit_no").withColumn("threat_class", F.element_at(classes, F.col("rule")))


def prepared(packets: DataFrame, idle: float = 15.0, active: float = 60.0) -> DataFrame:
    assembled = staged(fl.assemble_capture(packets, idle, active, lists=False), "flows")
    return staged(features(staged(describe_flows(assembled), "described")), "features")


def detect(packets: DataFrame, idle: float = 15.0, active: float = 60.0, quiet: float = 300.0, rules: list[Rule] | None = None) -> DataFrame:
    """Fused hits of a packet table: one row per flow and class, with all rules that hit it."""
    return fuse(flow_hits(prepared(packets, idle, active), rules, quiet), [*FLOW, "threat_class"]).drop("ord")


def alerts(packets: DataFrame, idle: float = 15.0, active: float = 60.0, quiet: float = 300.0, rules: list[Rule] | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Alerts of a packet table as records (operators/alerts.py): those of flows, with campaigns and what they confirm, and the fast
    lane's provisional ones. scores: of models, by ord (operators/ml.py)."""
    f = prepared(packets, idle, active)
    hits = staged(flow_hits(f, rules, quiet), "hits")
    own = staged(al.assemble(fuse(hits, [*FLOW, "threat_class"]), f, WINDOW, scores), "alerts")
    pivots = correlate.flow_pivots(correlate.refusals(f, WINDOW))
    joined = correlate.correlate(own, pivots)
    fast = fastlane.capture_hits(packets)
    provisional = staged(al.provisional(fast, hits, quiet), "provisional")
    return al.confirm(joined, provisional, quiet).unionByName(provisional, allowMissingColumns=True)


def top_flows(alerts_: DataFrame, f: DataFrame, scope: str) -> DataFrame:
    """alerts of one scope (dst or src; aid, entity, ord, last_time, flow_id) with their contributing flows."""
    named = alerts_.withColumnRenamed("entity", f"{scope}_ip")
    return sketches.contributing_flows(named, f, f"{scope}_ip", "total_bytes", "last_time", WINDOW, "flow_id")
