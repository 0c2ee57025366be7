"""Packets to flows: session cuts, directions, counters and ordered lists, in window functions and ordered folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.operators.ordered import fold_sorted


def cut_idle(packets: DataFrame, keys: list[str], idle: float, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """With gap (since the latest time so far, not negative), session (from 0): a gap of idle or more begins a new one.

    Rows are taken in order of seq. The latest time so far is a running maximum, so that a late packet does not cut.
    """
    order = Window.partitionBy(*keys).orderBy(seq)
    before = F.max(ts).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = packets.withColumn("latest", before).withColumn("fresh", (F.col(ts) - F.col("latest") >= idle).cast("int"))
    return marked.withColumn("session", F.coalesce(F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).withColumn(
        "gap", F.when(F.coalesce(F.col("fresh"), F.lit(1)) == 0, F.greatest(F.col(ts) - F.col("latest"), F.lit(0.0)))
    ).drop("fresh", "latest")


def cut_active(sessions: DataFrame, keys: list[str], active: float, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """cut_idle()'s rows with chunk (from 0): a packet `active` or more after its chunk's first one begins the next. Each cut depends
    on the last, so a key's rows, which the windows before have put in order, pass by as a stream."""

    def make() -> Callable[..., tuple]:
        session, first, chunk = None, 0.0, 0

        def step(now: int, t: float) -> tuple:
            nonlocal session, first, chunk
            if now != session:
                session, first, chunk = now, t, 0
            elif t - first >= active:
                first, chunk = t, chunk + 1
            return (chunk,)

        return step

    return fold_sorted(sessions, keys, [seq], ["session", ts], make, "chunk int", dealt=True)


def assemble(packets: DataFrame, keys: list[str], by: list[str], ts: str = "ts", seq: str = "seq", size: str = "packet_len", reply: str | None = None) -> DataFrame:
    """One row per (keys, by): times, counters per direction (reply marks the reverse one), flags, moments of sizes and gaps."""
    rev = F.col(reply) if reply else F.lit(False)
    flags = F.coalesce(F.col("tcp_flags"), F.lit(0))
    return packets.groupBy(*keys, *by).agg(
        F.min(ts).alias("start_time"),
        F.max(ts).alias("last_time"),
        F.count(F.lit(1)).alias("packet_count"),
        F.round(F.sum(size), 4).alias("total_bytes"),
        F.count_if(~rev).alias("fwd_packets"),
        F.count_if(rev).alias("rev_packets"),
        F.round(F.coalesce(F.sum(F.when(~rev, F.col(size))), F.lit(0.0)), 4).alias("fwd_bytes"),
        F.round(F.coalesce(F.sum(F.when(rev, F.col(size))), F.lit(0.0)), 4).alias("rev_bytes"),
        F.bit_or(flags).alias("tcp_flags_seen"),
        F.round(F.coalesce(F.avg("gap"), F.lit(0.0)), 4).alias("iat_mean"),
        F.round(F.coalesce(F.max("gap"), F.lit(0.0)), 4).alias("iat_max"),
    )


def describe(flows: DataFrame) -> DataFrame:
    """Duration, end flags and what of the flow was seen."""
    seen = F.when((F.col("fwd_packets") > 0) & (F.col("rev_packets") > 0), "bidirectional").when(F.col("fwd_packets") > 0, "forward_only").otherwise("reverse_only")
    bit = lambda b: F.col("tcp_flags_seen").bitwiseAND(b) != 0
    return flows.withColumns({"duration": F.round(F.greatest(F.col("last_time") - F.col("start_time"), F.lit(0.0)), 4), "has_syn": bit(2), "is_terminated": bit(1) | bit(4), "observability_state": seen})


def canonical(a: Column, b: Column) -> tuple[Column, Column]:
    """The same pair for both directions."""
    return F.least(a, b), F.greatest(a, b)


def first_by(value: Column, seq: str, where: Column | None = None) -> Column:
    """The value of the first row in order of seq, of those where it holds."""
    return F.min_by(value, F.col(seq)) if where is None else F.min_by(F.when(where, value), F.when(where, F.col(seq)))


def ordered_distinct(value: str, seq: str) -> Column:
    """Values in order of first sight, without repeats: an aggregate. Of tables with many repeats, first_sights() is lighter."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"]))


def first_sights(rows: DataFrame, keys: list[str], value: str, seq: str, name: str) -> DataFrame:
    """Per keys, the different values in order of first sight: what repeats is gone before anything is gathered. Nulls are no value."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(seq).alias("__s"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__s", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def responder(flags: Column, protocol: Column, dns_response: Column, icmp_type: Column, src_port: Column, dst_port: Column) -> Column:
    """If a flow's first packet came from the side that answers."""
    tcp = F.when(flags.bitwiseAND(2) != 0, flags.bitwiseAND(16) != 0)
    icmp = F.when(protocol == "ICMP", icmp_type.isin(0, 14, 16, 18)).when(protocol == "ICMPv6", icmp_type == 129)
    return F.coalesce(F.when(protocol == "TCP", tcp), dns_response, icmp, (src_port < 1024) & (dst_port >= 1024), F.lit(False))


#: Columns of packets whose values a flow lists, each once, in order of first sight.
LISTED = {"dns_query_name": "dns_queries", "tls_sni": "tls_snis", "tls_ja3": "tls_ja3", "tls_ja4": "tls_ja4", "tls_ja3s": "tls_ja3s"}


def _chunks(active: float) -> Callable[[], Callable[..., tuple]]:
    """Per packet: its chunk, the gap to the latest packet of the chunk before it, how that differs from the gap before, and which of
    the LISTED values the chunk sees for the first time. The state is a chunk's different values."""

    def make() -> Callable[..., tuple]:
        session, chunk, first, latest, gap = None, 0, 0.0, 0.0, None
        seen: list[set] = [set() for _ in LISTED]

        def step(now: int, t: float, *values: str | None) -> tuple:
            nonlocal session, chunk, first, latest, gap
            jump = None
            if now != session or t - first >= active:
                chunk = chunk + 1 if now == session else 0
                session, first, latest, gap = now, t, t, None
                for s in seen:
                    s.clear()
            else:
                before, gap = gap, max(t - latest, 0.0)
                jump, latest = None if before is None else abs(gap - before), max(t, latest)
            new = []
            for s, v in zip(seen, values):
                new.append(v is not None and v not in s)
                if v is not None:
                    s.add(v)
            return (chunk, gap, jump, *new)

        return step

    return make


def assemble_capture(packets: DataFrame, idle: float = 15.0, active: float = 60.0, with_source_port: bool = True, lists: bool = True) -> DataFrame:
    """Bidirectional flows of decoded packets (the schema of packets): cut by idle gaps, then by age, oriented by the session's
    first packet. Packets without address or protocol are left out. with_source_port: else four-part keys, never reversed.
    lists: with packet_sizes and iats, an entry per packet; what they are summed up to is there without them too."""
    p = packets.filter("src_ip is not null and dst_ip is not null and protocol is not null")
    sport, dport = F.coalesce("src_port", F.lit(0)), F.coalesce("dst_port", F.lit(0))
    here, there = F.struct(F.col("src_ip").alias("ip"), sport.alias("port")), F.struct(F.col("dst_ip").alias("ip"), dport.alias("port"))
    if with_source_port:
        p = p.withColumn("end_a", F.least(here, there)).withColumn("end_b", F.greatest(here, there))
    else:
        p = p.withColumn("end_a", F.struct(F.col("src_ip").alias("ip"), F.lit(0).alias("port"))).withColumn("end_b", there)
    keys = ["end_a", "end_b", "protocol"]
    cut = cut_idle(p, keys, idle).drop("gap")
    session = Window.partitionBy(*keys, "session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = responder(F.coalesce("tcp_flags", F.lit(0)), F.col("protocol"), F.col("dns_is_response"), F.col("icmp_type"), sport, dport)
    began = F.first(F.struct(F.col("src_ip").alias("src"), sport.alias("sport"), F.col("dst_ip").alias("dst"), dport.alias("dport"), answers.alias("answers"))).over(session)
    oriented = cut.withColumn("o", began).withColumn("rev", (F.col("src_ip") != F.col("o.src")) | (sport != F.col("o.sport")))
    marks = "chunk int, gap double, jump double, " + ", ".join(f"new_{c} boolean" for c in LISTED)
    oriented = fold_sorted(oriented, keys, ["seq"], ["session", "ts", *LISTED], _chunks(active), marks, dealt=True)
    flags = F.coalesce(F.col("tcp_flags"), F.lit(0))
    syn, synack = (flags.bitwiseAND(18) == 2), (flags.bitwiseAND(18) == 18)
    size = F.col("packet_len").cast("long")
    bytes_ = F.coalesce(F.col("packet_len"), F.lit(0)).cast("double")
    listed = {to: F.transform(F.array_sort(F.collect_list(F.when(F.col(f"new_{c}"), F.struct(F.col("seq").alias("s"), F.col(c).alias("v"))))), lambda x: x["v"]).alias(to) for c, to in LISTED.items()}
    each = F.array_sort(F.collect_list(F.struct(F.col("seq").alias("s"), F.col("packet_len").alias("v"), F.col("gap").alias("g"))))
    whole = [F.transform(each, lambda x: x["v"]).alias("packet_sizes"), F.transform(F.filter(each, lambda x: x["g"].isNotNull()), lambda x: x["g"]).alias("iats")] if lists else []
    return describe(
        oriented.groupBy(*keys, "session", "chunk").agg(
            *[F.first(f"o.{a}").alias(b) for a, b in (("src", "src_ip"), ("sport", "src_port"), ("dst", "dst_ip"), ("dport", "dst_port"), ("answers", "fwd_is_responder"))],
            F.min("ts").alias("start_time"), F.max("ts").alias("last_time"), F.count(F.lit(1)).alias("packet_count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
            *whole,
            F.min(bytes_).alias("pkt_size_min"), F.max(bytes_).alias("pkt_size_max"), F.avg(bytes_).alias("pkt_size_mean"), F.stddev_pop(bytes_).alias("pkt_size_std"),
            F.percentile(bytes_, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("pkt_size_q"),
            *[F.coalesce(f("gap"), F.lit(0.0)).alias(f"flow_iat_{n}") for n, f in (("mean", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max))],
            F.coalesce(F.avg("jump"), F.lit(0.0)).alias("jitter"), F.count_if(bytes_ < 64).alias("small_packets"),
            F.bit_or(flags).alias("tcp_flags_seen"),
            F.count_if(~F.col("rev")).alias("fwd_packets"), F.count_if("rev").alias("rev_packets"),
            F.coalesce(F.sum(F.when(~F.col("rev"), size)), F.lit(0)).alias("fwd_bytes"), F.coalesce(F.sum(F.when(F.col("rev"), size)), F.lit(0)).alias("rev_bytes"),
            F.coalesce(F.bit_or(F.when(~F.col("rev"), flags)), F.lit(0)).alias("fwd_tcp_flags"), F.coalesce(F.bit_or(F.when(F.col("rev"), flags)), F.lit(0)).alias("rev_tcp_flags"),
            first_by(F.col("ts"), "seq", syn).alias("syn_ts"), first_by(F.col("rev"), "seq", syn).alias("syn_rev"),
            first_by(F.col("ts"), "seq", synack).alias("synack_ts"), first_by(F.col("rev"), "seq", synack).alias("synack_rev"),
            F.count_if(F.coalesce(F.col("dns_is_response"), F.lit(False))).alias("dns_responses"),
            F.count_if(F.coalesce(F.col("dns_is_response"), F.lit(False)) & (F.col("dns_rcode") == 3)).alias("dns_nxdomain"),
            *listed.values(),
            F.first("icmp_type").alias("icmp_type"), F.first("icmp_code").alias("icmp_code"),
        )
    ).withColumn("reverse_seen", (F.col("fwd_packets") > 0) & (F.col("rev_packets") > 0))
