"""The fast lane: packets by tumbling window (a second, or any width), before flows are assembled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def windows(packets: DataFrame, width: float, opens: str) -> DataFrame:
    """With w, the window. Kept: packets of a destination from the first one on that opens its table in that window."""
    p = packets.withColumn("w", F.floor(F.col("ts") / width).cast("long"))
    first = F.min(F.when(F.expr(opens), F.col("seq"))).over(Window.partitionBy("w", "dst"))
    return p.withColumn("__first", first).filter("seq >= __first").drop("__first")


def unanswered(packets: DataFrame, target: list[str], syn: str, ack: str) -> DataFrame:
    """Per (w, target): opening packets, and whether none that answers came after the first of them."""
    return packets.groupBy("w", *target).agg(
        F.count_if(F.expr(syn)).alias("syns"),
        (~F.coalesce(F.min(F.when(F.expr(syn), F.col("seq"))) < F.max(F.when(F.expr(ack), F.col("seq"))), F.lit(False))).alias("silent"),
    ).filter("syns > 0")


def per_destination(packets: DataFrame, width: float, syn: str, ack: str, opens: str, cap: int = 4096) -> DataFrame:
    """Packets, opening packets, their sources (at most cap), the share of those that never went on, the sources' entropy."""
    p = windows(packets, width, opens)
    total = p.groupBy("w", "dst").agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.expr(syn)).alias("syns"))
    src = unanswered(p, ["dst", "src"], syn, ack)
    per = src.groupBy("w", "dst").agg(
        F.least(F.count(F.lit(1)), F.lit(cap)).alias("syn_srcs"),
        F.round(F.count_if("silent") / F.count(F.lit(1)), 6).alias("syn_only_share"),
        F.round(F.log2(F.sum("syns")) - F.sum(F.col("syns") * F.log2("syns")) / F.sum("syns") + 0.0, 6).alias("src_entropy"),
    )
    return total.join(per, ["w", "dst"])


def per_source(packets: DataFrame, width: float, syn: str, ack: str) -> DataFrame:
    """Targets (destination and port) a source opened to, destinations and ports among them, and the share left silent."""
    p = packets.withColumn("w", F.floor(F.col("ts") / width).cast("long"))
    t = unanswered(p, ["src", "dst", "dst_port"], syn, ack)
    return t.groupBy("w", "src").agg(F.count(F.lit(1)).alias("targets"), F.count_distinct("dst").alias("dsts"), F.count_distinct("dst_port").alias("ports"), F.round(F.count_if("silent") / F.count(F.lit(1)), 6).alias("silent_share"))


def unsolicited(packets: DataFrame, width: float, reflects: str, asks: str) -> DataFrame:
    """Per window and destination: reflecting senders that it asked nothing in this or the previous window, their bytes and mean."""
    p = packets.withColumn("w", F.floor(F.col("ts") / width).cast("long"))
    asked = p.filter(asks).select("dst", "src", F.explode(F.array(F.col("w"), F.col("w") + 1)).alias("w")).distinct()
    refl = p.filter(reflects).join(asked, ["dst", "src", "w"], "left_anti")
    return refl.groupBy("w", "dst").agg(F.count_distinct("src").alias("refl_srcs"), F.round(F.sum("packet_len"), 4).alias("refl_bytes"), F.round(F.avg("packet_len"), 4).alias("refl_mean"))


def ttl_spread(packets: DataFrame, width: float, syn: str, ttl: str = "ttl") -> DataFrame:
    """Per window and destination of opening packets: largest less smallest time to live; none counts as 0."""
    p = packets.withColumn("w", F.floor(F.col("ts") / width).cast("long")).filter(syn)
    x = F.coalesce(F.col(ttl), F.lit(0))
    return p.groupBy("w", "dst").agg((F.max(x) - F.min(x)).alias("ttl_spread"))


def top_contributors(packets: DataFrame, width: float, by: list[str], k: int = 5) -> DataFrame:
    """The k keys with most packets toward each destination in each window, with their rank."""
    p = packets.withColumn("w", F.floor(F.col("ts") / width).cast("long"))
    n = p.groupBy("w", "dst", *by).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("w", "dst").orderBy(F.desc("n"), *by))
    return n.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Class, severity, confidence and thresholds of the rules on windows of a second.
FAST_RULES = {
    "RULE_FAST_SYN_FLOOD": {"class": "THREAT_DDOS_VOLUME", "severity": "HIGH", "confidence": 0.7, "srcs": 50, "syn_only": 0.8},
    "RULE_FAST_UDP_REFLECTION": {"class": "THREAT_DDOS_VOLUME", "severity": "HIGH", "confidence": 0.7, "srcs": 20, "mean_pkt": 400.0, "bytes": 500_000},
    "RULE_FAST_SCAN": {"class": "THREAT_RECON_PORTSCAN", "severity": "MEDIUM", "confidence": 0.6, "targets": 20, "syn_only": 0.8},
}


def fast_rules(dst: DataFrame, min_srcs: int = 50, min_share: float = 0.8) -> DataFrame:
    return dst.filter((F.col("syn_srcs") >= min_srcs) & (F.col("syn_only_share") >= min_share))


def all_rules(dst: DataFrame, refl: DataFrame, src: DataFrame, thresholds: dict = FAST_RULES) -> DataFrame:
    """w, scope, entity, rule: windows of per_destination(), unsolicited() and per_source() that cross a rule."""
    f, r, s = (thresholds[n] for n in ("RULE_FAST_SYN_FLOOD", "RULE_FAST_UDP_REFLECTION", "RULE_FAST_SCAN"))
    named = lambda df, scope, rule: df.select("w", F.lit(scope).alias("scope"), F.col("dst" if scope == "dst" else "src").cast("string").alias("entity"), F.lit(rule).alias("rule"))
    flood = named(fast_rules(dst, f["srcs"], f["syn_only"]), "dst", "RULE_FAST_SYN_FLOOD")
    reflected = named(refl.filter((F.col("refl_srcs") >= r["srcs"]) & (F.col("refl_mean") >= r["mean_pkt"]) & (F.col("refl_bytes") >= r["bytes"])), "dst", "RULE_FAST_UDP_REFLECTION")
    scan = named(src.filter((F.col("targets") >= s["targets"]) & (F.col("silent_share") >= s["syn_only"])), "src", "RULE_FAST_SCAN")
    return flood.unionByName(reflected).unionByName(scan)


def capture_hits(packets: DataFrame, width: float = 1.0, k: int = 5) -> DataFrame:
    """Hits of all fast rules on decoded packets: w, scope, entity, rule, threat_class, severity, confidence, evidence, packets (toward
    the destination, or opening ones of the source) and contributors, the k five-part keys with most packets.

    Only a destination's packets from the first one on that opens it in its second count: a TCP opening, or UDP from a port that
    reflects.
    """
    from flowloom.functions import network
    from flowloom.operators.rules import evidence, over

    ports = ", ".join(map(str, network.REFLECTOR_PORTS))
    syn, ack = "protocol = 'TCP' and tcp_flags & 18 = 2", "protocol = 'TCP' and tcp_flags & 16 <> 0"
    reflects, asks = f"protocol = 'UDP' and src_port in ({ports})", f"protocol = 'UDP' and dst_port in ({ports})"
    p = packets.filter("src_ip is not null and dst_ip is not null and protocol is not null").withColumns({"src": F.col("src_ip"), "dst": F.col("dst_ip")})
    opened = windows(p, width, f"({syn}) or ({reflects})")
    total = opened.groupBy("w", "dst").agg(F.count(F.lit(1)).alias("fl_dst_packets_1s"), F.count_if(F.expr(syn)).alias("fl_dst_syns_1s"))
    per = per_destination(opened.drop("w"), width, syn, ack, f"({syn}) or ({reflects})").join(ttl_spread(opened.drop("w"), width, syn), ["w", "dst"], "left").drop("packets", "syns").join(total, ["w", "dst"])
    refl = unsolicited(p, width, reflects, asks).join(total, ["w", "dst"])
    src = per_source(p, width, syn, ack)
    names = {"syn_srcs": "fl_dst_syn_srcs_1s", "syn_only_share": "fl_dst_syn_only_share_1s", "src_entropy": "fl_dst_src_entropy_1s", "ttl_spread": "fl_dst_ttl_spread_1s"}
    seconds = F.floor(F.col("ts") / width).cast("long")
    t = FAST_RULES
    said = []

    def add(df: DataFrame, rule: str, scope: str, when: Column, told: list[Column], count: str) -> None:
        x = t[rule]
        said.append(df.filter(when).select("w", F.lit(scope).alias("scope"), F.col(scope).alias("entity"), F.lit(rule).alias("rule"), F.lit(x["class"]).alias("threat_class"), F.lit(x["severity"]).alias("severity"), F.lit(x["confidence"]).alias("confidence"), F.array(*told).alias("evidence"), F.col(count).cast("long").alias("packets")))

    x = t["RULE_FAST_SYN_FLOOD"]
    told = [over("fl_dst_syn_srcs_1s", x["srcs"]), over("fl_dst_syn_only_share_1s", x["syn_only"]), *[evidence(n, F.col(n)) for n in ("fl_dst_syns_1s", "fl_dst_packets_1s", "fl_dst_src_entropy_1s", "fl_dst_ttl_spread_1s")]]
    add(per.withColumnsRenamed(names), "RULE_FAST_SYN_FLOOD", "dst", (F.col("fl_dst_syn_srcs_1s") >= x["srcs"]) & (F.col("fl_dst_syn_only_share_1s") >= x["syn_only"]), told, "fl_dst_packets_1s")
    x = t["RULE_FAST_UDP_REFLECTION"]
    told = [over("fl_dst_refl_srcs_1s", x["srcs"]), over("fl_dst_refl_mean_pkt_1s", x["mean_pkt"]), over("fl_dst_refl_bytes_1s", x["bytes"]), evidence("fl_dst_packets_1s", F.col("fl_dst_packets_1s"))]
    when = (F.col("fl_dst_refl_srcs_1s") >= x["srcs"]) & (F.col("fl_dst_refl_mean_pkt_1s") >= x["mean_pkt"]) & (F.col("fl_dst_refl_bytes_1s") >= x["bytes"])
    add(refl.withColumnsRenamed({"refl_srcs": "fl_dst_refl_srcs_1s", "refl_bytes": "fl_dst_refl_bytes_1s", "refl_mean": "fl_dst_refl_mean_pkt_1s"}), "RULE_FAST_UDP_REFLECTION", "dst", when, told, "fl_dst_packets_1s")
    x = t["RULE_FAST_SCAN"]
    syns = p.filter(syn).groupBy(seconds.alias("w"), "src").agg(F.count(F.lit(1)).alias("opened"))
    told = [over("fl_src_syn_targets_1s", x["targets"]), over("fl_src_syn_only_share_1s", x["syn_only"]), *[evidence(n, F.col(n)) for n in ("fl_src_distinct_dsts_1s", "fl_src_distinct_ports_1s")]]
    scans = src.withColumnsRenamed({"targets": "fl_src_syn_targets_1s", "silent_share": "fl_src_syn_only_share_1s", "dsts": "fl_src_distinct_dsts_1s", "ports": "fl_src_distinct_ports_1s"}).join(syns, ["w", "src"])
    add(scans, "RULE_FAST_SCAN", "src", (F.col("fl_src_syn_targets_1s") >= x["targets"]) & (F.col("fl_src_syn_only_share_1s") >= x["syn_only"]), told, "opened")
    hits = said[0].unionByName(said[1]).unionByName(said[2])
    # who contributed: opening packets and reflections toward a destination, or a source's targets
    five = [F.col("protocol"), F.col("src"), F.col("dst"), F.coalesce("src_port", F.lit(0)).alias("sport"), F.coalesce("dst_port", F.lit(0)).alias("dport")]
    made = p.filter(f"({syn}) or ({reflects})").select(seconds.alias("w"), *five)
    toward = made.groupBy("w", F.col("dst").alias("entity"), "protocol", "src", "dst", "sport", "dport").agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit("dst"))
    away = made.filter("protocol = 'TCP'").withColumn("sport", F.lit(0)).groupBy("w", F.col("src").alias("entity"), "protocol", "src", "dst", "sport", "dport").agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit("src"))
    both = toward.unionByName(away).join(hits.select("w", "scope", "entity").distinct(), ["w", "scope", "entity"], "left_semi")
    order = Window.partitionBy("w", "scope", "entity").orderBy(F.desc("n"), "src", "dst", "sport", "dport")
    first = both.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).withColumn("flow_id", network.community_id("protocol", "src", "dst", "sport", "dport"))
    tops = first.groupBy("w", "scope", "entity").agg(F.array_sort(F.collect_list(F.struct("r", "protocol", "src", "dst", "sport", "dport", "flow_id"))).alias("contributors"))
    return hits.join(tops, ["w", "scope", "entity"])
