"""Registered queries over the provided tables, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.functions import network, text
from flowloom.operators import alertlog, alerts, correlate, evaluate, fastlane, flows, folds, ml, rollups, rules, sketches, tier1
from flowloom.sources import tables as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

DAY = t.DAY
IDLE, ACTIVE, WINDOW, HOUR = 2 * DAY, 5 * DAY, 30 * DAY, 3600.0
SYN, ACK, OPENS = "tcp_flags = 2", "tcp_flags IN (16, 17, 24)", "tcp_flags = 2 OR tcp_flags = 4"


def query(sql: str | None = None, *ctes: str):
    """Register a query by its function's name, with its SQL over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(ctes)}\n" if ctes else "") + sql
        return f

    return add


def rounded(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + 0.0).alias(name)


SESSIONS_SQL = f"""lagged AS (SELECT *, max(ts) OVER (PARTITION BY src, dst ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM pkt),
marked AS (SELECT *, CASE WHEN ts - latest >= {IDLE} THEN 1 ELSE 0 END AS fresh FROM lagged),
ses AS (SELECT *, sum(fresh) OVER (PARTITION BY src, dst ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS session, CASE WHEN fresh = 0 AND latest IS NOT NULL THEN greatest(ts - latest, 0.0) END AS gap FROM marked)"""

FLOW_AGG_SQL = """min(ts) AS start_time, max(ts) AS last_time, count(*) AS packet_count, round(sum(packet_len), 4) AS total_bytes,
count(*) FILTER (NOT is_reply) AS fwd_packets, count(*) FILTER (is_reply) AS rev_packets,
round(coalesce(sum(packet_len) FILTER (NOT is_reply), 0.0), 4) AS fwd_bytes, round(coalesce(sum(packet_len) FILTER (is_reply), 0.0), 4) AS rev_bytes,
bit_or(tcp_flags) AS tcp_flags_seen, round(coalesce(avg(gap), 0.0), 4) AS iat_mean, round(coalesce(max(gap), 0.0), 4) AS iat_max"""
DESCRIBE_SQL = """round(greatest(last_time - start_time, 0.0), 4) AS duration, tcp_flags_seen & 2 <> 0 AS has_syn, (tcp_flags_seen & 1 <> 0 OR tcp_flags_seen & 4 <> 0) AS is_terminated,
CASE WHEN fwd_packets > 0 AND rev_packets > 0 THEN 'bidirectional' WHEN fwd_packets > 0 THEN 'forward_only' ELSE 'reverse_only' END AS observability_state"""


def sessions(spark, sf):
    return flows.cut_idle(t.packets(spark, sf), ["src", "dst"], IDLE)


@query(f"SELECT *, {DESCRIBE_SQL} FROM (SELECT src, dst, session, {FLOW_AGG_SQL} FROM ses GROUP BY src, dst, session)", t.PKT_SQL, SESSIONS_SQL)
def flow_sessions(spark, sf):
    return flows.describe(flows.assemble(sessions(spark, sf), ["src", "dst"], ["session"], reply="is_reply"))


@query(
    f"SELECT *, {DESCRIBE_SQL} FROM (SELECT src, dst, session, chunk, {FLOW_AGG_SQL} FROM ses JOIN cut USING (src, dst, session, n) GROUP BY src, dst, session, chunk)",
    "RECURSIVE " + t.PKT_SQL,
    SESSIONS_SQL.replace("ses AS (SELECT *,", "ses0 AS (SELECT *,") + ", ses AS (SELECT *, row_number() OVER (PARTITION BY src, dst, session ORDER BY seq) AS n FROM ses0)",
    f"""cut AS (SELECT src, dst, session, n, ts AS first, 0 AS chunk FROM ses WHERE n = 1
  UNION ALL SELECT s.src, s.dst, s.session, s.n, CASE WHEN s.ts - c.first >= {ACTIVE} THEN s.ts ELSE c.first END, c.chunk + CASE WHEN s.ts - c.first >= {ACTIVE} THEN 1 ELSE 0 END
  FROM cut c JOIN ses s ON s.src = c.src AND s.dst = c.dst AND s.session = c.session AND s.n = c.n + 1)""",
)
def flow_sessions_active_split(spark, sf):
    cut = flows.cut_active(sessions(spark, sf), ["src", "dst"], ACTIVE)
    return flows.describe(flows.assemble(cut, ["src", "dst"], ["session", "chunk"], reply="is_reply"))


@query(
    """SELECT src, dst, session, count(*) AS n, round(count(*) / CASE WHEN max(ts) > min(ts) THEN max(ts) - min(ts) ELSE 1 END, 6) AS pps,
round(min(packet_len), 4) AS size_min, round(max(packet_len), 4) AS size_max, round(avg(packet_len) + 1e-9, 4) AS size_mean, round(stddev_pop(packet_len), 4) AS size_std,
round(quantile_cont(packet_len, 0.25) + 1e-9, 4) AS q25, round(quantile_cont(packet_len, 0.5) + 1e-9, 4) AS q50, round(quantile_cont(packet_len, 0.75) + 1e-9, 4) AS q75,
round(coalesce(var_pop(gap), 0.0), 2) AS iat_var, round(coalesce(avg(abs(gap - pgap)), 0.0), 3) AS jitter,
round(stddev_pop(packet_len) / (avg(packet_len) + 1e-6), 5) AS burstiness, round((count(*) FILTER (packet_len < 64)) / count(*), 6) AS small_ratio
FROM (SELECT *, lag(gap) OVER (PARTITION BY src, dst, session ORDER BY seq) AS pgap FROM ses) GROUP BY src, dst, session""",
    t.PKT_SQL,
    SESSIONS_SQL,
)
def flow_tier1_features(spark, sf):
    s = sessions(spark, sf).withColumn("pgap", F.lag("gap").over(Window.partitionBy("src", "dst", "session").orderBy("seq")))
    size, span = F.col("packet_len"), F.max("ts") - F.min("ts")
    q = F.percentile("packet_len", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    r = lambda c, d, n: F.round(c, d).alias(n)
    out = s.groupBy("src", "dst", "session").agg(
        F.count(F.lit(1)).alias("n"), r(F.count(F.lit(1)) / F.when(span > 0, span).otherwise(1.0), 6, "pps"), r(F.min(size), 4, "size_min"), r(F.max(size), 4, "size_max"), r(F.avg(size) + 1e-9, 4, "size_mean"), r(F.stddev_pop(size), 4, "size_std"),
        q.alias("q"), r(F.coalesce(F.var_pop("gap"), F.lit(0.0)), 2, "iat_var"), r(F.coalesce(F.avg(F.abs(F.col("gap") - F.col("pgap"))), F.lit(0.0)), 3, "jitter"),
        r(F.stddev_pop(size) / (F.avg(size) + 1e-6), 5, "burstiness"), r(F.count_if(size < 64) / F.count(F.lit(1)), 6, "small_ratio"),
    )
    return out.select("*", *[F.round(F.col("q")[i] + 1e-9, 4).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]).drop("q")


@query("SELECT src, string_agg(dst, ',' ORDER BY first) AS kinds, count(*) AS n FROM (SELECT src, dst, min(seq) AS first FROM pkt GROUP BY src, dst) GROUP BY src", t.PKT_SQL)
def ordered_distinct_lists(spark, sf):
    return flows.first_sights(t.packets(spark, sf), ["src"], "dst", "seq", "kinds").select("src", F.array_join("kinds", ",").alias("kinds"), F.size("kinds").cast("long").alias("n"))


@query("SELECT src, arg_min(ts, seq) FILTER (tcp_flags = 2) AS syn_ts, arg_min(is_reply, seq) FILTER (tcp_flags = 4) AS reset_reply, arg_min(dst_port, seq) AS first_port FROM pkt GROUP BY src", t.PKT_SQL)
def handshake_min_by(spark, sf):
    syn, rst = F.col("tcp_flags") == 2, F.col("tcp_flags") == 4
    return t.packets(spark, sf).groupBy("src").agg(flows.first_by(F.col("ts"), "seq", syn).alias("syn_ts"), flows.first_by(F.col("is_reply"), "seq", rst).alias("reset_reply"), flows.first_by(F.col("dst_port"), "seq").alias("first_port"))


@query("SELECT a, b, count(*) AS n, count(DISTINCT port) AS ports FROM (SELECT least(src % 30, dst) AS a, greatest(src % 30, dst) AS b, port FROM flw) GROUP BY a, b", t.FLW_SQL)
def canonical_pair_flows(spark, sf):
    a, b = flows.canonical(F.col("src") % 30, F.col("dst").cast("long"))
    return t.flows(spark, sf).select(a.alias("a"), b.alias("b"), "port").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("port").alias("ports"))


@query("SELECT seq, CASE WHEN tcp_flags & 2 <> 0 THEN tcp_flags & 16 <> 0 ELSE dst_port < 50 AND packet_len >= 50 END AS answers FROM pkt", t.PKT_SQL)
def responder_case(spark, sf):
    p = t.packets(spark, sf)
    none = F.lit(None).cast("boolean")
    # ports as the heuristic sees them: under 1024 is a service
    src, dst = F.when(F.col("dst_port") < 50, 80).otherwise(5000), F.when(F.col("packet_len") >= 50, 5000).otherwise(80)
    return p.select("seq", flows.responder(F.col("tcp_flags"), F.lit("TCP"), none, F.lit(None).cast("int"), src, dst).alias("answers"))


@query(
    """SELECT page_id, qname, length(qname) - length(replace(qname, '.', '')) AS depth, length(qname) AS length, round((SELECT coalesce(entropy(c), 0) FROM (SELECT unnest(string_split(qname, '')) AS c)), 9) + 0.0 AS entropy,
round((SELECT coalesce(entropy(c), 0) FROM (SELECT unnest(string_split(split_part(qname, '.', 1), '')) AS c)), 9) + 0.0 AS first_entropy FROM qnm""",
    t.NAMES_SQL,
)
def qname_lexical(spark, sf):
    q = t.names(spark, sf)
    return q.select("page_id", "qname", text.label_depth("qname").cast("long").alias("depth"), F.length("qname").cast("long").alias("length"), F.round(text.entropy("qname"), 9).alias("entropy"), F.round(text.entropy(text.first_label("qname")), 9).alias("first_entropy"))


@query("SELECT CASE WHEN p <= 0 THEN 0 WHEN p < 1024 THEN 1 WHEN p < 49152 THEN 2 ELSE 3 END AS port_class, count(*) AS n FROM (SELECT (seq * 7919) % 65536 AS p FROM pkt) GROUP BY 1", t.PKT_SQL)
def port_class(spark, sf):
    return t.packets(spark, sf).select(network.port_class((F.col("seq") * 7919) % 65536).alias("port_class")).groupBy("port_class").agg(F.count(F.lit(1)).alias("n"))


DIRECTED_SQL = """dir AS (SELECT seq, packet_len AS f, dst_port::DOUBLE AS r, src % 3 <> 0 AS si, seq % 3 = 0 AS di FROM pkt),
way AS (SELECT *, CASE WHEN si AND di THEN 'internal' WHEN si THEN 'outbound' WHEN di THEN 'inbound' ELSE 'external' END AS way FROM dir)"""


def _directed(spark, sf):
    net = F.element_at(F.array(F.lit("8.8"), F.lit("10.1"), F.lit("192.168")), (F.col("src") % 3 + 1).cast("int"))
    far = F.when(F.col("seq") % 3 == 0, F.lit("172.20")).otherwise(F.lit("172.40"))
    ip = lambda a, x: F.concat(a, F.lit("."), (x % 200).cast("string"), F.lit(".7"))
    p = t.packets(spark, sf).select("seq", F.col("packet_len").alias("f"), F.col("dst_port").cast("double").alias("r"), ip(net, F.col("src")).alias("src_ip"), ip(far, F.col("seq")).alias("dst_ip"))
    return p.withColumn("way", network.direction(network.in_networks("src_ip"), network.in_networks("dst_ip")))


@query("SELECT way, count(*) AS n, round(sum(CASE way WHEN 'outbound' THEN f WHEN 'inbound' THEN r ELSE 0 END), 4) + 0.0 AS egress FROM way GROUP BY way", t.PKT_SQL, DIRECTED_SQL)
def cidr_direction_egress(spark, sf):
    d = _directed(spark, sf)
    return d.groupBy("way").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(network.egress_bytes(F.col("way"), F.col("f"), F.col("r"))), 4).alias("egress"))


@query("SELECT seq, r > 0 AS available, CASE WHEN r > 0 THEN round(CASE way WHEN 'outbound' THEN f / r WHEN 'inbound' THEN r / nullif(f, 0) END + 1e-10, 6) END AS ratio FROM way", t.PKT_SQL, DIRECTED_SQL)
def reverse_ratio_available(spark, sf):
    d = _directed(spark, sf)
    both = F.col("r") > 0
    return d.select("seq", both.alias("available"), F.when(both, F.round(network.byte_ratio(F.col("way"), F.col("f"), F.col("r")) + 1e-10, 6)).alias("ratio"))


@query("SELECT event_id, (isodow(l) > 5 OR hour(l) < 9 OR hour(l) >= 18) AS off_hours FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS l FROM events)")
def off_hours_events(spark, sf):
    return t.read(spark, sf, "events").select("event_id", network.off_hours(F.col("ts").cast("timestamp_ntz")).alias("off_hours"))


# Rollups. In SQL, each flow is joined with the rows of its key that its two windows hold up to it.

FLW_W = t.FLW_SQL + f", f AS (SELECT *, floor(last / {WINDOW})::BIGINT AS wid FROM flw)"
ORD = "(o.start, o.ok, o.ln, o.pk, o.src) <= (f.start, f.ok, f.ln, f.pk, f.src)"
KEYS = ["ok", "ln", "pk", "src"]


def _asof_sql(key: str, values: str) -> str:
    return f"SELECT f.ok, f.ln, f.pk, f.src, {values} FROM f JOIN f o ON o.{key} = f.{key} AND (o.wid = f.wid - 1 OR (o.wid = f.wid AND {ORD})) GROUP BY ALL"


def _sums(spark, sf, key, sums):
    return rollups.running_sums(t.flows(spark, sf), [key], sums, width=WINDOW)


@query(_asof_sql("src", "count(*) AS src_flows_w"), FLW_W)
def src_running_counts(spark, sf):
    return _sums(spark, sf, "src", {"src_flows_w": F.lit(1)}).select(*KEYS, "src_flows_w")


@query(_asof_sql("dst", "count(*) AS dst_flows_w, round(sum(o.bytes), 2) AS dst_bytes_w"), FLW_W)
def dst_running_bytes(spark, sf):
    return _sums(spark, sf, "dst", {"dst_flows_w": F.lit(1), "dst_bytes_w": F.col("bytes")}).select(*KEYS, "dst_flows_w", rounded("dst_bytes_w", 2))


@query(_asof_sql("src", "round((count(*) FILTER (o.syn_only AND o.proto = 'F')) / nullif(count(*) FILTER (o.proto = 'F'), 0), 6) AS src_syn_only_ratio_w"), FLW_W)
def syn_only_ratio(spark, sf):
    tcp = F.col("proto") == "F"
    x = _sums(spark, sf, "src", {"s": (F.col("syn_only") & tcp).cast("long"), "n": tcp.cast("long")})
    return x.select(*KEYS, F.round(F.try_divide("s", "n"), 6).alias("src_syn_only_ratio_w"))


@query(_asof_sql("dst", "round((count(*) FILTER (o.syn_only)) / count(*), 6) AS dst_syn_only_ratio_w"), FLW_W)
def dst_syn_only_ratio(spark, sf):
    return _sums(spark, sf, "dst", {"s": F.col("syn_only").cast("long"), "n": F.lit(1)}).select(*KEYS, F.round(F.col("s") / F.col("n"), 6).alias("dst_syn_only_ratio_w"))


@query(_asof_sql("src", "count(DISTINCT o.dst) AS src_distinct_dsts_w, count(DISTINCT o.port) AS src_distinct_dst_ports_w"), FLW_W)
def src_running_distinct_dsts(spark, sf):
    x = rollups.running_distinct(t.flows(spark, sf), ["src"], {"src_distinct_dsts_w": "dst", "src_distinct_dst_ports_w": "port"}, width=WINDOW)
    return x.select(*KEYS, "src_distinct_dsts_w", "src_distinct_dst_ports_w")


@query(_asof_sql("dst", "count(DISTINCT o.src) AS dst_distinct_srcs_w"), FLW_W)
def dst_running_srcs(spark, sf):
    return rollups.running_distinct(t.flows(spark, sf), ["dst"], {"dst_distinct_srcs_w": "src"}, width=WINDOW).select(*KEYS, "dst_distinct_srcs_w")


@query("SELECT ok, ln, pk, src, sum(new) OVER (PARTITION BY dst ORDER BY start, ok, ln, pk, src ROWS UNBOUNDED PRECEDING)::BIGINT AS dst_distinct_srcs_longterm FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY dst, src ORDER BY start, ok, ln, pk) = 1 THEN 1 ELSE 0 END AS new FROM flw)", t.FLW_SQL)
def dst_longterm_srcs(spark, sf):
    return rollups.longterm_distinct(t.flows(spark, sf), ["dst"], "src", "dst_distinct_srcs_longterm").select(*KEYS, "dst_distinct_srcs_longterm")


@query("SELECT ok, ln, pk, src, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS dst_src_entropy_w FROM (" + _asof_sql("dst", "o.src AS other, count(*) AS n") + ") GROUP BY ALL", FLW_W)
def dst_running_entropy(spark, sf):
    return rollups.running_entropy(t.flows(spark, sf), ["dst"], "src", "dst_src_entropy_w", width=WINDOW).select(*KEYS, rounded("dst_src_entropy_w"))


PERIODIC_SQL = """gaps AS (SELECT *, CASE WHEN start >= prev THEN start - prev END AS gap FROM (SELECT *, max(start) OVER (PARTITION BY src, dst ORDER BY start, ok, ln, pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM flw)),
per AS (SELECT *, count(gap) OVER w AS iat_n, avg(gap) OVER w AS iat_mean, CASE WHEN count(gap) OVER w >= 2 THEN stddev_samp(gap) OVER w END AS iat_sd FROM gaps WINDOW w AS (PARTITION BY src, dst ORDER BY start, ok, ln, pk ROWS UNBOUNDED PRECEDING)),
pair AS (SELECT *, CASE WHEN iat_n >= 2 AND iat_mean > 0 THEN iat_sd / iat_mean END AS iat_cv FROM per)"""


@query("SELECT ok, ln, pk, src, iat_n, round(iat_mean, 3) AS iat_mean, round(iat_cv, 6) AS iat_cv FROM pair", t.FLW_SQL, PERIODIC_SQL)
def pair_periodicity(spark, sf):
    return rollups.periodicity(t.flows(spark, sf), ["src", "dst"]).select(*KEYS, "iat_n", rounded("iat_mean", 3), F.round("iat_cv", 6).alias("iat_cv"))


@query(_asof_sql("src", "count(DISTINCT CASE WHEN o.periodic THEN o.dst END) AS src_periodic_dsts_w"), t.FLW_SQL, PERIODIC_SQL, f"f AS (SELECT *, floor(last / {WINDOW})::BIGINT AS wid, coalesce(iat_cv <= 0.9 AND iat_n >= 3, false) AS periodic FROM pair)")
def src_periodic_dsts(spark, sf):
    p = rollups.periodicity(t.flows(spark, sf), ["src", "dst"])
    marked = p.withColumn("periodic_dst", F.when((F.col("iat_cv") <= 0.9) & (F.col("iat_n") >= 3), F.col("dst")))
    return rollups.running_distinct(marked, ["src"], {"src_periodic_dsts_w": "periodic_dst"}, width=WINDOW).select(*KEYS, "src_periodic_dsts_w")


@query("SELECT ok, ln, pk, src, count(*) OVER (PARTITION BY src, dst ORDER BY start, ok, ln, pk ROWS UNBOUNDED PRECEDING) AS pair_history_count FROM flw", t.FLW_SQL)
def pair_history(spark, sf):
    return rollups.running_count(t.flows(spark, sf), ["src", "dst"], "pair_history_count").select(*KEYS, "pair_history_count")


@query("SELECT ok, ln, pk, src, count(*) OVER (PARTITION BY port ORDER BY start, ok, ln, pk, src ROWS UNBOUNDED PRECEDING) AS item_prevalence FROM flw", t.FLW_SQL)
def item_prevalence(spark, sf):
    return rollups.running_count(t.flows(spark, sf), ["port"], "item_prevalence").select(*KEYS, "item_prevalence")


@query(
    """SELECT f.ok, f.ln, f.pk, f.src, round(sum(o.bytes) FILTER (o.wid = f.wid), 2) AS egress_1, round(sum(o.bytes) FILTER (o.wid > f.wid - 3), 2) AS egress_3, round(sum(o.bytes), 2) AS egress_12
FROM f JOIN f o ON o.src = f.src AND ((o.wid < f.wid AND o.wid > f.wid - 12) OR (o.wid = f.wid AND (o.start, o.ok, o.ln, o.pk) <= (f.start, f.ok, f.ln, f.pk))) GROUP BY ALL""",
    FLW_W,
)
def egress_buckets(spark, sf):
    x = rollups.bucket_sums(t.flows(spark, sf), "src", "bytes", {"egress_1": 1, "egress_3": 3, "egress_12": 12}, width=WINDOW)
    return x.select(*KEYS, *[rounded(c, 2) for c in ("egress_1", "egress_3", "egress_12")])


#: Baselines: per key a list of all buckets from its first to its last, empty ones too, folded in order.
BASE_SQL = """b AS (SELECT {key} AS k, floor(last / {width})::BIGINT AS b, sum(bytes) AS v FROM flw GROUP BY 1, 2),
span AS (SELECT k, unnest(range(min(b), max(b) + 1)) AS b FROM b GROUP BY k),
dense AS (SELECT k, b, coalesce(v, 0.0) AS v, v IS NOT NULL AS here, row_number() OVER (PARTITION BY k ORDER BY b) - 1 AS n FROM span LEFT JOIN b USING (k, b)),
fold AS (SELECT k, b, v, n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS var, here FROM dense WHERE n = 0
  UNION ALL SELECT d.k, d.b, d.v, d.n, CASE WHEN f.n = 0 THEN f.v ELSE f.mean + 0.1 * (f.v - f.mean) END,
  CASE WHEN f.n = 0 THEN 0.0 ELSE 0.9 * (f.var + 0.1 * (f.v - f.mean) * (f.v - f.mean)) END, d.here FROM fold f JOIN dense d ON d.k = f.k AND d.n = f.n + 1)"""


def _base(spark, sf, key):
    f = t.flows(spark, sf)
    per = f.groupBy(key, F.floor(F.col("last") / (10 * DAY)).cast("long").alias("b")).agg(F.sum("bytes").alias("v"))
    return folds.ewma_baseline(per, key, "b", ["v"])


@query(
    "SELECT k AS src, b, n AS closed, round(CASE WHEN n >= 5 THEN (v - mean) / greatest(sqrt(var), 0.1 * mean, 1.0) END, 5) AS z FROM fold WHERE here",
    "RECURSIVE " + t.FLW_SQL,
    BASE_SQL.format(key="src", width=10 * DAY),
)
def egress_ewma_z(spark, sf):
    x = _base(spark, sf, "src")
    z = (F.col("v") - F.col("v_mean")) / F.greatest(F.sqrt("v_var"), 0.1 * F.col("v_mean"), F.lit(1.0))
    return x.select("src", "b", "closed", F.round(F.when(F.col("closed") >= 5, z), 5).alias("z"))


@query("SELECT k AS dst, b, round(CASE WHEN n >= 5 THEN v / greatest(mean, 1.0) END, 6) AS dst_bytes_vs_baseline FROM fold WHERE here", "RECURSIVE " + t.FLW_SQL, BASE_SQL.format(key="dst", width=10 * DAY))
def dst_vs_baseline(spark, sf):
    x = _base(spark, sf, "dst")
    return x.select("dst", "b", F.round(F.when(F.col("closed") >= 5, F.col("v") / F.greatest("v_mean", F.lit(1.0))), 6).alias("dst_bytes_vs_baseline"))


@query(
    """SELECT m.ok, m.ln, m.pk, m.src, round((cs + coalesce(s, 0)) / (cn + coalesce(n, 0)), 6) AS link_visibility FROM
(SELECT *, count(*) OVER w AS cn, sum(reverse_seen::INT) OVER w AS cs FROM f WINDOW w AS (PARTITION BY wid ORDER BY start, ok, ln, pk, src ROWS UNBOUNDED PRECEDING)) m
LEFT JOIN (SELECT wid + 1 AS wid, count(*) AS n, sum(reverse_seen::INT) AS s FROM f GROUP BY 1) p USING (wid)""",
    FLW_W,
)
def link_visibility(spark, sf):
    return rollups.link_visibility(t.flows(spark, sf), "reverse_seen", width=WINDOW).select(*KEYS, rounded("link_visibility"))


@query(
    """SELECT ok, ln, pk, src, victim, count(*) OVER w AS reflector_flows, round(sum(b) OVER w, 2) AS reflector_bytes, round(sum(b) OVER w / sum(p) OVER w, 4) AS reflector_mean_pkt FROM
(SELECT ok, ln, pk, src, start, dst AS victim, bytes AS b, packets AS p FROM flw WHERE port < 128 AND NOT reverse_seen
 UNION ALL SELECT ok, ln, pk, src, start, src % 25 AS victim, bytes, packets FROM flw WHERE port >= 128 AND port < 200 AND NOT reverse_seen)
WINDOW w AS (PARTITION BY victim ORDER BY start, ok, ln, pk, src ROWS UNBOUNDED PRECEDING)""",
    t.FLW_SQL,
)
def reflector_rollup(spark, sf):
    f = t.flows(spark, sf).filter(~F.col("reverse_seen"))
    a = f.filter("port < 128").withColumn("victim", F.col("dst").cast("long"))
    b = f.filter("port >= 128 and port < 200").withColumn("victim", F.col("src") % 25)
    w = Window.partitionBy("victim").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    x = a.unionByName(b)
    return x.select(*KEYS, "victim", F.count(F.lit(1)).over(w).alias("reflector_flows"), F.round(F.sum("bytes").over(w), 2).alias("reflector_bytes"), F.round(F.sum("bytes").over(w) / F.sum("packets").over(w), 4).alias("reflector_mean_pkt"))


@query(
    """SELECT f.ok, f.ln, f.pk, f.src, coalesce(max(o.c), 0) AS seen_toward_src FROM flw f LEFT JOIN
(SELECT dst, start, ok, ln, pk, src, count(*) OVER (PARTITION BY dst ORDER BY start, ok, ln, pk, src ROWS UNBOUNDED PRECEDING) AS c FROM flw) o
ON o.dst = f.src % 25 AND (o.start, o.ok, o.ln, o.pk, o.src) <= (f.start, f.ok, f.ln, f.pk, f.src) GROUP BY ALL""",
    t.FLW_SQL,
)
def cross_key_probe(spark, sf):
    f = t.flows(spark, sf)
    tier = rollups.running_count(f, ["dst"], "c").select(F.col("dst").cast("long").alias("key"), "ord", "c")
    readers = f.select((F.col("src") % 25).alias("key"), "ord", *KEYS)
    return rollups.probe(tier, readers, ["key"]).select(*KEYS, F.coalesce("c", F.lit(0)).alias("seen_toward_src"))


# The fast lane, by hour.

FAST_SQL = f"fw AS (SELECT *, floor(ts / {6 * HOUR})::BIGINT AS w FROM pkt)"
FAST = 6 * HOUR


@query(
    f"""SELECT g.w, g.dst, packets, syns, least(count(*), 4096) AS syn_srcs, round((count(*) FILTER (silent)) / count(*), 6) AS syn_only_share, round(log2(sum(s)) - sum(s * log2(s)) / sum(s), 6) + 0.0 AS src_entropy FROM
(SELECT w, dst, count(*) AS packets, count(*) FILTER ({SYN}) AS syns FROM kept GROUP BY w, dst) g JOIN
(SELECT w, dst, src, count(*) FILTER ({SYN}) AS s, NOT coalesce(min(seq) FILTER ({SYN}) < max(seq) FILTER ({ACK}), false) AS silent FROM kept GROUP BY w, dst, src HAVING count(*) FILTER ({SYN}) > 0) x ON g.w = x.w AND g.dst = x.dst GROUP BY g.w, g.dst, packets, syns""",
    t.PKT_SQL + ", pkt2 AS (SELECT seq, ts, src, (dst_port % 4)::VARCHAR AS dst, dst_port, packet_len, tcp_flags, is_reply FROM pkt)",
    FAST_SQL.replace("FROM pkt", "FROM pkt2"),
    f"kept AS (SELECT * FROM (SELECT *, min(seq) FILTER ({OPENS}) OVER (PARTITION BY w, dst) AS first FROM fw) WHERE seq >= first)",
)
def fast_dst(spark, sf):
    p = t.packets(spark, sf).withColumn("dst", (F.col("dst_port") % 4).cast("string"))
    return fastlane.per_destination(p, FAST, SYN, ACK, OPENS)


@query(
    f"""SELECT w, src, count(*) AS targets, count(DISTINCT dst) AS dsts, count(DISTINCT dst_port) AS ports, round((count(*) FILTER (silent)) / count(*), 6) AS silent_share FROM
(SELECT w, src, dst, dst_port, NOT coalesce(min(seq) FILTER ({SYN}) < max(seq) FILTER ({ACK}), false) AS silent FROM fw GROUP BY w, src, dst, dst_port HAVING count(*) FILTER ({SYN}) > 0) GROUP BY w, src""",
    t.PKT_SQL,
    f"fw AS (SELECT * REPLACE ('h' || (dst_port % 3) AS dst, dst_port % 5 AS dst_port), floor(ts / {FAST})::BIGINT AS w FROM pkt)",
)
def fast_src(spark, sf):
    p = t.packets(spark, sf).withColumns({"dst": F.concat(F.lit("h"), (F.col("dst_port") % 3).cast("string")), "dst_port": F.col("dst_port") % 5})
    return fastlane.per_source(p, FAST, SYN, ACK)


@query(
    f"""SELECT w, dst, count(DISTINCT src) AS refl_srcs, round(sum(packet_len), 4) AS refl_bytes, round(avg(packet_len), 4) AS refl_mean FROM fw r WHERE dst_port < 30
AND NOT EXISTS (SELECT 1 FROM fw q WHERE q.dst_port >= 70 AND q.src = r.src AND q.dst = r.dst AND q.w IN (r.w, r.w - 1)) GROUP BY w, dst""",
    t.PKT_SQL,
    FAST_SQL.replace(str(FAST), str(4 * DAY)),
)
def fast_unsolicited(spark, sf):
    return fastlane.unsolicited(t.packets(spark, sf), 4 * DAY, "dst_port < 30", "dst_port >= 70")


@query(f"SELECT w, dst, src, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY w, dst ORDER BY n DESC, src)::INTEGER AS rank FROM (SELECT w, dst, src, count(*) AS n FROM fw GROUP BY w, dst, src)) WHERE rank <= 5", t.PKT_SQL, FAST_SQL.replace(str(FAST), str(DAY)))
def fast_top5(spark, sf):
    return fastlane.top_contributors(t.packets(spark, sf), DAY, ["src"])


# Rules, with thresholds that fit the tables.


def _pair_features(spark, sf):
    f = rollups.periodicity(t.flows(spark, sf), ["src", "dst"])
    return rollups.running_all(f, ["src"], {"flows": F.lit(1), "syn": F.col("syn_only").cast("long"), "egress": F.col("bytes")}, {"dsts": "dst", "ports": "port"}, width=WINDOW)


HITS_SQL = [
    t.FLW_SQL,
    PERIODIC_SQL,
    f"f AS (SELECT *, floor(last / {WINDOW})::BIGINT AS wid FROM pair)",
    """roll AS (SELECT f.ok, f.ln, f.pk, f.src, f.dst, f.start, f.iat_n, f.iat_cv, f.iat_mean, f.bytes, f.reverse_seen, count(DISTINCT o.dst) AS dsts, count(DISTINCT o.port) AS ports, count(*) AS flows, count(*) FILTER (o.syn_only) AS syn, sum(o.bytes) AS egress
  FROM f JOIN f o ON o.src = f.src AND (o.wid = f.wid - 1 OR (o.wid = f.wid AND (o.start, o.ok, o.ln, o.pk) <= (f.start, f.ok, f.ln, f.pk))) GROUP BY ALL)""",
    """hits AS (SELECT ok, ln, pk, src, dst, start, 'c2' AS detector, 'PERIODIC' AS rule, 'HIGH' AS severity, 0.8 AS confidence, src || '>' || dst AS entity FROM roll WHERE iat_n >= 16 AND iat_cv <= 0.95 AND iat_mean >= 10
  UNION ALL SELECT ok, ln, pk, src, dst, start, 'recon', 'FANOUT', CASE WHEN greatest(dsts, ports) >= 14 THEN 'HIGH' ELSE 'MEDIUM' END, 0.8, src::VARCHAR FROM roll WHERE greatest(dsts, ports) >= 10 AND syn >= 0.5 * flows
  UNION ALL SELECT ok, ln, pk, src, dst, start, 'exfil', 'RATIO', 'HIGH', 0.85, NULL FROM roll WHERE reverse_seen AND egress >= 500000 AND bytes >= 90000
  UNION ALL SELECT ok, ln, pk, src, dst, start, 'exfil', 'BASELINE', 'MEDIUM', 0.75, NULL FROM roll WHERE NOT reverse_seen AND egress >= 400000 AND bytes >= 90000)""",
]
HIT_COLS = ["ok", "ln", "pk", "src", "dst", "start"]


def _hits(spark, sf):
    x = _pair_features(spark, sf)
    fan = F.greatest("dsts", "ports")
    made = [
        rules.Rule("PERIODIC", rules.at_least("iat_n", 16) & F.coalesce(F.col("iat_cv") <= 0.95, F.lit(False)) & rules.at_least("iat_mean", 10), "c2", "HIGH", 0.8, F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))),
        rules.Rule("FANOUT", (fan >= 10) & (F.col("syn") >= 0.5 * F.col("flows")), "recon", F.when(fan >= 14, "HIGH").otherwise("MEDIUM"), 0.8, F.col("src")),
        rules.Rule("RATIO", F.col("reverse_seen") & rules.at_least("egress", 500000) & rules.at_least("bytes", 90000), "exfil", "HIGH", 0.85, F.lit(None)),
        rules.Rule("BASELINE", ~F.col("reverse_seen") & rules.at_least("egress", 400000) & rules.at_least("bytes", 90000), "exfil", "MEDIUM", 0.75, F.lit(None)),
    ]
    return rules.apply_rules(x, made, HIT_COLS)


@query("SELECT ok, ln, pk, src, detector, rule, severity, confidence::DOUBLE AS confidence, entity FROM hits", *HITS_SQL)
def rule_hits(spark, sf):
    return _hits(spark, sf).select("ok", "ln", "pk", "src", "detector", "rule", "severity", "confidence", "entity")


@query(
    """SELECT ok, ln, pk, src, dst, CASE WHEN others <= 40 AND n >= 3 AND bytes <= 30000 THEN 'RARE' END AS rule FROM (SELECT *, count(*) OVER (PARTITION BY port ORDER BY start, ok, ln, pk, src ROWS UNBOUNDED PRECEDING) -
count(*) OVER (PARTITION BY port, dst ORDER BY start, ok, ln, pk, src ROWS UNBOUNDED PRECEDING) AS others, count(*) OVER (PARTITION BY port, dst ORDER BY start, ok, ln, pk, src ROWS UNBOUNDED PRECEDING) AS n FROM flw) WHERE others <= 40 AND n >= 3 AND bytes <= 30000""",
    t.FLW_SQL,
)
def rule_rare_item(spark, sf):
    f = rollups.running_count(rollups.running_count(t.flows(spark, sf), ["port"], "everyone"), ["port", "dst"], "n")
    hit = (F.col("everyone") - F.col("n") <= 40) & (F.col("n") >= 3) & (F.col("bytes") <= 30000)
    return f.filter(hit).select(*KEYS, "dst", F.lit("RARE").alias("rule"))


DNS_SQL = """dns AS (SELECT split_part(qname, '.', 2) AS client, count(*) AS queries, count(DISTINCT qname) AS names, sum(length(qname)) AS length, count(*) FILTER (e >= 2.0) AS high,
  count(*) FILTER (page_id % 5 < 2) AS nx, count(*) FILTER (page_id % 2 = 0) AS answered FROM (SELECT *, coalesce((SELECT entropy(c) FROM (SELECT unnest(string_split(split_part(qname, '.', 1), '')) AS c)), 0) AS e FROM qnm) GROUP BY 1)"""


def _dns(spark, sf):
    q = t.names(spark, sf).withColumn("e", text.entropy(text.first_label("qname")))
    parts = F.split("qname", r"\.")
    return q.groupBy(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("client")).agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("qname").alias("names"), F.sum(F.length("qname")).alias("length"), F.count_if(F.round("e", 9) >= 2.0).alias("high"), F.count_if(F.col("page_id") % 5 < 2).alias("nx"), F.count_if(F.col("page_id") % 2 == 0).alias("answered"))


@query("SELECT client, queries, round(length / queries, 4) AS mean_length FROM dns WHERE queries >= 5 AND length >= 20 * queries", t.NAMES_SQL, DNS_SQL.replace("e >= 2.0", "round(e, 9) >= 2.0"))
def rule_tunnel(spark, sf):
    return _dns(spark, sf).filter((F.col("queries") >= 5) & (F.col("length") >= 20 * F.col("queries"))).select("client", "queries", F.round(F.col("length") / F.col("queries"), 4).alias("mean_length"))


@query("SELECT client, CASE WHEN answered = 0 THEN 'unavailable' WHEN nx >= 0.4 * queries THEN 'nxdomain' ELSE 'resolves' END AS branch, high, names FROM dns WHERE high >= 2 AND names >= 2", t.NAMES_SQL, DNS_SQL.replace("e >= 2.0", "round(e, 9) >= 2.0"))
def rule_dga_branches(spark, sf):
    branch = F.when(F.col("answered") == 0, "unavailable").when(F.col("nx") >= 0.4 * F.col("queries"), "nxdomain").otherwise("resolves")
    return _dns(spark, sf).filter("high >= 2 and names >= 2").select("client", branch.alias("branch"), "high", "names")


@query(
    """SELECT src, seq, ts FROM kept""",
    "RECURSIVE " + t.PKT_SQL,
    f"""kept AS (SELECT src, arg_min(seq, (ts, seq)) AS seq, min(ts) AS ts FROM pkt GROUP BY src
  UNION ALL (SELECT k.src, arg_min(p.seq, (p.ts, p.seq)), min(p.ts) FROM kept k JOIN pkt p ON p.src = k.src AND p.ts - k.ts >= {DAY} GROUP BY k.src, k.seq))""",
)
def rule_dedupe(spark, sf):
    return folds.suppress(t.packets(spark, sf), ["src"], DAY).select("src", "seq", "ts")


FUSED_SQL = """fused AS (SELECT ok, ln, pk, src, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS rank, max(confidence)::DOUBLE AS confidence FROM hits GROUP BY ok, ln, pk, src),
model AS (SELECT ok, ln, pk, src, (ok * 31 + ln * 7 + pk) % 1000 / 1000.0 AS score FROM flw)"""
_NAMED = "CASE {} WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' END"


def _model(spark, sf):
    return t.flows(spark, sf).select(*KEYS, ((F.col("ok") * 31 + F.col("ln") * 7 + F.col("pk")) % 1000 / 1000.0).alias("score"))


@query(f"SELECT ok, ln, pk, src, rules, {_NAMED.format('least(rank + CASE WHEN score > 0.9 THEN 1 ELSE 0 END, 4)')} AS severity, round(CASE WHEN score > 0.9 THEN greatest(confidence, score) ELSE confidence END, 4)::DOUBLE AS confidence FROM fused JOIN model USING (ok, ln, pk, src)", *HITS_SQL, FUSED_SQL)
def fusion_severity(spark, sf):
    fused = rules.fuse(_hits(spark, sf), KEYS)
    return rules.agree(fused, _model(spark, sf), KEYS, 0.9).select(*KEYS, "rules", "severity", "confidence")


@query("SELECT ok, ln, pk, src, 'MEDIUM' AS severity, score::DOUBLE AS confidence FROM model WHERE score > 0.99 AND NOT EXISTS (SELECT 1 FROM fused WHERE fused.ok = model.ok AND fused.ln = model.ln AND fused.pk = model.pk AND fused.src = model.src)", *HITS_SQL, FUSED_SQL)
def ml_only_gate(spark, sf):
    x = rules.agree(rules.fuse(_hits(spark, sf), KEYS), _model(spark, sf), KEYS, 0.99, alone=True)
    return x.filter("rules is null").select(*KEYS, "severity", "confidence")


# The alert log.


@query("SELECT alert_id, ts, severity, host FROM alr WHERE threat_class = 'ERROR' AND severity = 'CRITICAL' ORDER BY ts DESC, alert_id DESC LIMIT 50", t.ALERTS_SQL)
def alerts_topk(spark, sf):
    return alertlog.search(t.alerts(spark, sf), "ERROR", "CRITICAL", 50).select("alert_id", "ts", "severity", "host")


@query(
    f"""SELECT campaign_id, alerts, first_seen, last_seen, {_NAMED.format('rank')} AS severity, hosts, classes FROM
(SELECT campaign_id, count(*) AS alerts, min(ts) AS first_seen, max(ts) AS last_seen, max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS rank FROM alr WHERE campaign_id IS NOT NULL GROUP BY 1)
JOIN (SELECT campaign_id, string_agg(host::VARCHAR, ',' ORDER BY f) AS hosts FROM (SELECT campaign_id, host, min(alert_id) AS f FROM alr WHERE campaign_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (campaign_id)
JOIN (SELECT campaign_id, string_agg(threat_class, ',' ORDER BY f) AS classes FROM (SELECT campaign_id, threat_class, min(alert_id) AS f FROM alr WHERE campaign_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (campaign_id)""",
    t.ALERTS_SQL,
)
def campaign_summary(spark, sf):
    return alertlog.campaigns(t.alerts(spark, sf))


@query("SELECT alert_id, host, severity FROM alr WHERE campaign_id = 'camp-3' ORDER BY alert_id LIMIT 5000", t.ALERTS_SQL)
def campaign_detail(spark, sf):
    return alertlog.campaign_detail(t.alerts(spark, sf), "camp-3").select("alert_id", "host", "severity")


@query("SELECT host, threat_class, count(*) AS alerts, min(ts) AS first_seen, max(ts) AS last_seen FROM alr GROUP BY 1, 2", t.ALERTS_SQL)
def host_timeline(spark, sf):
    return alertlog.host_timeline(t.alerts(spark, sf))


@query("SELECT threat_class, count(*) FILTER (provisional) AS provisional, count(*) FILTER (NOT provisional) AS confirmed, max(ts) AS last_seen FROM alr GROUP BY 1", t.ALERTS_SQL)
def class_stats(spark, sf):
    return alertlog.class_stats(t.alerts(spark, sf))


@query("SELECT alert_id, threat_class FROM alr WHERE alert_id BETWEEN 498 AND 502", t.ALERTS_SQL)
def chain_blocks(spark, sf):
    return alertlog.neighbourhood(t.alerts(spark, sf), 500).select("alert_id", "threat_class")


@query("SELECT count(*) AS records, min(ts) AS \"first\", max(ts) AS \"last\", count(DISTINCT severity) AS severities FROM alr", t.ALERTS_SQL)
def log_manifest(spark, sf):
    return alertlog.manifest(t.alerts(spark, sf))


CHAIN_SQL = """ord AS (SELECT conv_id, turn, role || '|' || text AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM log),
link AS (SELECT conv_id, turn, n, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || d) AS record_hash FROM ord WHERE n = 1
  UNION ALL SELECT o.conv_id, o.turn, o.n, l.record_hash, sha256(l.record_hash || o.d) FROM link l JOIN ord o ON o.conv_id = l.conv_id AND o.n = l.n + 1)"""


def _document():
    return F.concat(F.col("role"), F.lit("|"), F.col("text"))


@query("SELECT conv_id, turn, prev_hash, record_hash FROM link", "RECURSIVE " + t.LOG_SQL, CHAIN_SQL)
def hash_chain(spark, sf):
    return folds.chain(t.log(spark, sf), ["conv_id"], _document(), "turn")


@query("SELECT conv_id, count(*) AS records, CASE WHEN conv_id % 3 = 0 AND count(*) > 1 THEN 1 END::BIGINT AS first_bad FROM log GROUP BY conv_id", t.LOG_SQL)
def chain_verify(spark, sf):
    """Every third log has the text of its second record changed after it was written."""
    log = t.log(spark, sf)
    chained = log.join(folds.chain(log, ["conv_id"], _document(), "turn"), ["conv_id", "turn"])
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    edited = chained.withColumn("text", F.when((F.col("conv_id") % 3 == 0) & (place == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return folds.verify_chain(edited, ["conv_id"], _document(), "turn")


@query(
    f"""SELECT a.seq, CASE WHEN a.ts - b.ts < {DAY} THEN b.seq END AS provisional FROM (SELECT * FROM pkt WHERE tcp_flags = 16) a
ASOF LEFT JOIN (SELECT src, ts, max(seq) AS seq FROM pkt WHERE tcp_flags = 2 GROUP BY src, ts) b ON a.src = b.src AND a.ts >= b.ts""",
    t.PKT_SQL,
)
def provisional_confirm_asof(spark, sf):
    p = t.packets(spark, sf)
    left = p.filter("tcp_flags = 16").select("src", "ts", "seq")
    right = p.filter("tcp_flags = 2").select("src", "ts", F.col("seq").alias("provisional"))
    return folds.as_of(left, right, ["src"], "ts", "provisional", DAY).select("seq", "provisional")


@query(
    """SELECT event_id, p AS "pivot", df, round(ln((least(event_id, 1000) + 1000) / (df + 1)), 6) AS rarity FROM
(SELECT a.event_id, a.p, count(o.event_id) AS df FROM piv a LEFT JOIN piv o ON o.p = a.p AND o.event_id >= a.event_id - 1000 AND o.event_id < a.event_id GROUP BY a.event_id, a.p)""",
    "piv AS (SELECT event_id, 'host:' || user_id AS p FROM events UNION ALL SELECT event_id, 'class:' || event_type FROM events)",
)
def pivot_idf(spark, sf):
    e = t.read(spark, sf, "events")
    pivots = F.array(F.concat(F.lit("host:"), F.col("user_id").cast("string")), F.concat(F.lit("class:"), F.col("event_type")))
    x = correlate.pivot_rarity(e, pivots, "event_id")
    return x.select("event_id", "pivot", "df", rounded("rarity"))


@query()
def campaigns(spark, sf):
    e = t.read(spark, sf, "events")
    pivots = F.array(F.concat(F.lit("host:"), F.col("user_id").cast("string")), F.concat(F.lit("port:"), F.get_json_object("props", "$.k")), F.concat(F.lit("value:"), F.floor("value").cast("string")))
    return correlate.join_campaigns(e.select(F.col("event_id").alias("alert_id"), t.seconds("ts").alias("ts"), pivots.alias("pivots")), near=2 * DAY).select("alert_id", "campaign_id")


# Labels and evaluation.

LABEL_SQL = f"lbl AS (SELECT event_id AS lid, user_id AS key, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 60 AS e, event_type AS code FROM events), flo AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) / 1e6 - 1800 AS start, epoch_us(ts) / 1e6 - 1800 - value * 20 + value * 40 AS last FROM events)"


def _overlap(spark, sf):
    e = t.read(spark, sf, "events").withColumn("t", t.seconds("ts"))
    lbl = e.select(F.col("event_id").alias("lid"), F.col("user_id").alias("key"), F.col("t").alias("s"), (F.col("t") + F.col("value") * 60).alias("e"), F.col("event_type").alias("code"))
    flo = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), (F.col("t") - 1800).alias("start"), (F.col("t") - 1800 - F.col("value") * 20 + F.col("value") * 40).alias("last"))
    return flo, lbl


@query(
    "SELECT id, CASE count(DISTINCT code) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS state, CASE WHEN count(DISTINCT code) = 1 THEN min(code) END AS label FROM flo LEFT JOIN lbl ON lbl.key = flo.key AND s <= last + 1 AND e >= start - 1 GROUP BY id",
    LABEL_SQL,
)
def label_overlap_join(spark, sf):
    flo, lbl = _overlap(spark, sf)
    return evaluate.overlap_join(flo, lbl, ["key"]).select("id", "state", "label")


@query("SELECT code, count(*) AS rows, count(*) FILTER (EXISTS (SELECT 1 FROM flo WHERE flo.key = lbl.key AND s <= last + 1 AND e >= start - 1)) AS matched FROM lbl GROUP BY code", LABEL_SQL)
def label_coverage(spark, sf):
    flo, lbl = _overlap(spark, sf)
    return evaluate.coverage(lbl, flo, ["key"])


@query('SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY "group" ORDER BY score, doc_id) <= floor(count(*) OVER (PARTITION BY "group") * 0.7) THEN \'train\' ELSE \'test\' END AS fold FROM lab', t.LAB_SQL)
def time_split(spark, sf):
    return evaluate.time_split(t.labelled(spark, sf), "group", "score", "doc_id").select("doc_id", "fold")


@query('SELECT "group", count(*) AS test_n, sum(y)::BIGINT AS test_pos, ((SELECT count(*) FROM lab) - count(*))::BIGINT AS train_n, ((SELECT sum(y) FROM lab) - sum(y))::BIGINT AS train_pos FROM lab GROUP BY "group"', t.LAB_SQL)
def logo_folds(spark, sf):
    return evaluate.group_folds(t.labelled(spark, sf), "group", "y")


@query('SELECT "group", score::DOUBLE AS threshold FROM (SELECT "group", score, row_number() OVER (PARTITION BY "group" ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY "group") AS n FROM lab WHERE y = 0) WHERE r = floor(n * 0.1) + 1', t.LAB_SQL)
def budget_threshold(spark, sf):
    return evaluate.budget_threshold(t.labelled(spark, sf), "group", "y", "score", 0.1)


@query(
    """SELECT "group", tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp * 10000.0 / nullif(neg, 0), 6)::DOUBLE AS fp_per_10k FROM
(SELECT "group", count(*) FILTER (y = 1 AND score > 0.5) AS tp, count(*) FILTER (y = 0 AND score > 0.5) AS fp, count(*) FILTER (y = 1 AND score <= 0.5) AS fn, count(*) FILTER (y = 0) AS neg FROM lab GROUP BY "group")""",
    t.LAB_SQL,
)
def metrics_at_threshold(spark, sf):
    return t.labelled(spark, sf).groupBy("group").agg(*evaluate.at_threshold("y", F.col("score") > 0.5))


@query(
    """SELECT "group", round(sum(p * cp / cn) / nullif(sum(p), 0), 6) AS average_precision FROM (SELECT "group", p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM
(SELECT "group", score, sum(y) AS p, count(*) AS n FROM lab GROUP BY "group", score) WINDOW w AS (PARTITION BY "group" ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY "group\"""",
    t.LAB_SQL,
)
def average_precision(spark, sf):
    return evaluate.average_precision(t.labelled(spark, sf), "group", "y", "score")


@query("SELECT least(floor(score * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(score), 6)::DOUBLE AS mean_score, round(avg(y), 6) AS share, round(avg((score - y) * (score - y)), 6)::DOUBLE AS brier FROM lab GROUP BY 1", t.LAB_SQL)
def calibration_brier(spark, sf):
    return evaluate.calibration(t.labelled(spark, sf), "y", "score")


@query(
    """SELECT b AS "min_bytes", p AS "min_packets", tp::BIGINT AS tp, fp::BIGINT AS fp, tp >= pos * 0.9 AS keeps, row_number() OVER (ORDER BY (tp >= pos * 0.9) DESC, tp + fp, tp / nullif(tp + fp, 0) DESC, b, p)::INTEGER AS rank FROM
(SELECT b, p, count(*) FILTER (y = 1 AND bytes >= b AND packets >= p) AS tp, count(*) FILTER (y = 0 AND bytes >= b AND packets >= p) AS fp, count(*) FILTER (y = 1) AS pos
 FROM (SELECT floor(bytes / 10000) * 10000 AS bytes, packets, (syn_only AND bytes > 3000)::INT AS y FROM flw), (SELECT unnest([0.0, 5000.0, 10000.0, 20000.0])::DOUBLE AS b), (SELECT unnest([0.0, 2.0, 5.0, 10.0])::DOUBLE AS p) GROUP BY b, p)""",
    t.FLW_SQL,
)
def threshold_sweep(spark, sf):
    f = t.flows(spark, sf).select((F.floor(F.col("bytes") / 10000) * 10000).cast("double").alias("bytes"), "packets", (F.col("syn_only") & (F.col("bytes") > 3000)).cast("int").alias("y"))
    return evaluate.sweep(f, "y", {"bytes": [0, 5000, 10000, 20000], "packets": [0, 2, 5, 10]})


@query(
    """SELECT role, sha256(string_agg(d, '' ORDER BY p)) AS digest, sum(n)::BIGINT AS n FROM
(SELECT role, substr(h, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM (SELECT role, sha256(text) AS h FROM log) GROUP BY 1, 2) GROUP BY role""",
    t.LOG_SQL,
)
def log_digest(spark, sf):
    return evaluate.digest(t.log(spark, sf), F.col("text"), ["role"])


@query(
    """SELECT a.seq, coalesce(f.code, n.code, 'unknown') AS label FROM pkt a LEFT JOIN (SELECT src, dst, dst_port, min(tcp_flags)::VARCHAR AS code FROM pkt WHERE is_reply GROUP BY ALL) f ON f.src = a.src AND f.dst = a.dst AND f.dst_port = a.dst_port
LEFT JOIN (SELECT src, dst, 'entity' AS code FROM pkt WHERE dst_port < 10 GROUP BY ALL) n ON n.src = a.src AND n.dst = a.dst""",
    t.PKT_SQL,
)
def alert_label_fallback(spark, sf):
    p = t.packets(spark, sf)
    by_flow = p.filter("is_reply").groupBy("src", "dst", "dst_port").agg(F.min("tcp_flags").cast("string").alias("code"))
    by_entity = p.filter("dst_port < 10").select("src", "dst").distinct().withColumn("entity", F.lit("entity"))
    return p.join(by_flow, ["src", "dst", "dst_port"], "left").join(by_entity, ["src", "dst"], "left").select("seq", F.coalesce("code", "entity", F.lit("unknown")).alias("label"))


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT DISTINCT src, dst, session FROM ses)", t.PKT_SQL, SESSIONS_SQL)
def shard_difference(spark, sf):
    """Flows of the whole table against those of two shards that keep both directions of a pair together: all are in both."""
    p = t.packets(spark, sf)
    make = lambda x: flows.assemble(flows.cut_idle(x, ["src", "dst"], IDLE), ["src", "dst"], ["session"], reply="is_reply").select("src", "dst", "session", "packet_count", "total_bytes")
    shard = F.pmod(F.xxhash64("src", "dst"), F.lit(2))
    whole, parts = make(p), make(p.filter(shard == 0)).unionByName(make(p.filter(shard == 1)))
    both = whole.intersectAll(parts).withColumn("side", F.lit("both"))
    return evaluate.multiset_difference(whole, parts).unionByName(both).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT src, count(DISTINCT dst) AS dsts, true AS near FROM flw GROUP BY src", t.FLW_SQL)
def hll_vs_exact(spark, sf):
    """Sketched distinct counts next to exact ones: within 30 % at 256 registers."""
    x = t.flows(spark, sf).groupBy("src").agg(F.count_distinct("dst").alias("dsts"), F.hll_sketch_estimate(F.hll_sketch_agg(F.col("dst").cast("long"), 12)).alias("est"))
    return x.select("src", "dsts", (F.abs(F.col("est") - F.col("dsts")) <= 0.3 * F.col("dsts") + 1).alias("near"))


@query()
def iforest_scores(spark, sf):
    return ml.isolation_scores(t.read(spark, sf, "embeddings"))


@query()
def gbt_scores(spark, sf):
    return ml.tree_scores(t.flows(spark, sf))


@query(
    """SELECT dst, period, c AS decayed FROM fold""",
    "RECURSIVE " + t.PKT_SQL,
    f"""d AS (SELECT dst, floor(ts / {DAY})::BIGINT AS period, count(*) AS n, row_number() OVER (PARTITION BY dst ORDER BY floor(ts / {DAY})::BIGINT) AS i FROM pkt GROUP BY 1, 2),
fold AS (SELECT dst, period, n AS c, i FROM d WHERE i = 1 UNION ALL SELECT d.dst, d.period, floor(f.c / pow(2, d.period - f.period))::BIGINT + d.n, d.i FROM fold f JOIN d ON d.dst = f.dst AND d.i = f.i + 1)""",
)
def decayed_history(spark, sf):
    return sketches.decayed_counts(t.packets(spark, sf), ["dst"], "ts")


HASHED_SQL = "('0x' || substr(md5({row} || ':' || {item}), 1, 8))::BIGINT % {buckets}"


@query(
    "SELECT f.src, count(*) AS exact, min(c.n)::BIGINT AS estimate FROM flw f JOIN cells c ON c.src = f.src GROUP BY f.src".replace("min(c.n)", "(SELECT min(t.n) FROM cells c2 JOIN tab t USING (row, cell) WHERE c2.src = f.src)").replace(" JOIN cells c ON c.src = f.src", ""),
    t.FLW_SQL,
    "cells AS (SELECT DISTINCT src, row, " + HASHED_SQL.format(row="row", item="src", buckets=64) + " AS cell FROM flw, (SELECT unnest(range(4)) AS row))",
    "tab AS (SELECT row, cell, sum(n) AS n FROM cells JOIN (SELECT src, count(*) AS n FROM flw GROUP BY src) USING (src) GROUP BY row, cell)",
)
def count_min_vs_exact(spark, sf):
    """Count-min estimates in a narrow table, next to the exact counts: never under them."""
    f = t.flows(spark, sf)
    exact = f.groupBy("src").agg(F.count(F.lit(1)).alias("exact"))
    return exact.join(sketches.count_min_estimate(sketches.count_min(f, "src", 64), exact, "src", 64), "src").select("src", "exact", "estimate")


@query(
    "SELECT dst, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS entropy FROM (SELECT dst, " + HASHED_SQL.format(row="0", item="src", buckets=16) + " AS b, count(*) AS n FROM flw GROUP BY 1, 2) GROUP BY dst",
    t.FLW_SQL,
)
def bucket_entropy_bound(spark, sf):
    """Entropy of hash buckets of sources, at most log2(buckets) bits."""
    return sketches.bucket_entropy(t.flows(spark, sf), ["dst"], "src", 16).select("dst", rounded("entropy"))


@query(
    f"""SELECT ok, ln, pk, src, dst, rank FROM (SELECT *, row_number() OVER (PARTITION BY dst, floor(last / {WINDOW}) ORDER BY bytes DESC, start, ok, ln, pk, src)::INTEGER AS rank FROM flw) WHERE rank <= 5""",
    t.FLW_SQL,
)
def window_top_flows(spark, sf):
    return sketches.top_of_window(t.flows(spark, sf), "dst", "bytes", "last", WINDOW).select(*KEYS, "dst", "rank")


@query(
    """SELECT p.seq AS id, arg_min(a.name, (abs(p.ts - a.first), a.name)) AS attack FROM pkt p LEFT JOIN att a ON a.src = p.src AND p.ts >= a.first - 5 AND p.ts <= a.last + 120 GROUP BY p.seq""",
    t.PKT_SQL,
    "att AS (SELECT src, dst AS name, ts AS first, ts + packet_len * 600 AS last FROM pkt WHERE tcp_flags = 4)",
)
def attack_attribution(spark, sf):
    p = t.packets(spark, sf)
    attacks = p.filter("tcp_flags = 4").select("src", F.col("dst").alias("name"), F.col("ts").alias("first"), (F.col("ts") + F.col("packet_len") * 600).alias("last"))
    return sketches.attribute(p.select("src", F.col("seq").alias("id"), F.col("ts").alias("t")), attacks, ["src"]).select("id", "attack")


# Alerts as records, their log, and what judges them.


@query(
    f"SELECT ok, ln, pk, src, 'win:src:' || src || ':' || (floor(last / {WINDOW}) * {WINDOW})::BIGINT || ':' || {int(WINDOW)} AS window_id FROM hits JOIN flw USING (ok, ln, pk, src) WHERE hits.rule = 'FANOUT'",
    *HITS_SQL,
)
def alert_window_ids(spark, sf):
    """Ids of the windows that alerts on a source are about."""
    hits = _hits(spark, sf).filter("rule = 'FANOUT'").join(t.flows(spark, sf).select(*KEYS, "last"), KEYS)
    return hits.select(*KEYS, alerts.window_id(F.lit("src"), F.col("entity"), F.floor(F.col("last") / WINDOW) * WINDOW, WINDOW).alias("window_id"))


@query(
    """SELECT ok, ln, pk, src, trig || coalesce((SELECT string_agg(',' || c, '' ORDER BY n) FROM (SELECT c, row_number() OVER (ORDER BY r) AS n FROM best b WHERE (b.ok, b.ln, b.pk, b.src) = (a.ok, a.ln, a.pk, a.src) AND c <> trig AND r <= 5) WHERE n <= 4), '') AS contributing FROM als a""",
    *HITS_SQL,
    f"als AS (SELECT ok, ln, pk, src, h.start, floor(w.last / {WINDOW}) AS w, ok || '-' || ln || '-' || pk AS trig FROM hits h JOIN flw w USING (ok, ln, pk, src) WHERE rule = 'FANOUT')",
    f"""best AS (SELECT a.ok, a.ln, a.pk, a.src, o.ok || '-' || o.ln || '-' || o.pk AS c, row_number() OVER (PARTITION BY a.ok, a.ln, a.pk, a.src ORDER BY o.bytes DESC, o.start, o.ok, o.ln, o.pk) AS r
  FROM als a JOIN flw o ON o.src = a.src AND floor(o.last / {WINDOW}) = a.w AND (o.start, o.ok, o.ln, o.pk) <= (a.start, a.ok, a.ln, a.pk))""",
)
def contributing_flows(spark, sf):
    """The flow that set an alert off, then the heaviest others of its source in the window so far."""
    f = t.flows(spark, sf).withColumn("fid", F.concat_ws("-", "ok", "ln", "pk"))
    a = _hits(spark, sf).filter("rule = 'FANOUT'").select(*KEYS).join(f.select(*KEYS, "ord", "last", "fid"), KEYS).withColumn("aid", F.concat_ws("-", *KEYS))
    got = sketches.contributing_flows(a, f, "src", "bytes", "last", WINDOW, "fid")
    return got.select(*KEYS, F.array_join("contributing", ",").alias("contributing"))


@query(
    f"""SELECT f.ok, f.ln, f.pk, f.src, f.e AS "end", count(o.ok) AS reflector_flows, round(coalesce(sum(o.bytes), 0), 2) AS reflector_bytes, round(sum(o.bytes) / sum(o.packets) + 1e-9, 3) AS reflector_mean_pkt
FROM ends f LEFT JOIN vic o ON o.victim = f.ip AND (o.wid = f.wid - 1 OR (o.wid = f.wid AND {ORD})) GROUP BY f.ok, f.ln, f.pk, f.src, f.e""",
    FLW_W,
    """vic AS (SELECT *, CASE WHEN port < 128 THEN dst ELSE src % 25 END AS victim FROM f WHERE port < 200 AND NOT reverse_seen),
ends AS (SELECT *, 'dst' AS e, dst AS ip FROM f WHERE dst IN (SELECT victim FROM vic) UNION ALL SELECT *, 'src' AS e, src % 25 AS ip FROM f WHERE src % 25 IN (SELECT victim FROM vic))""",
)
def reflection_both_ends(spark, sf):
    """What reflectors sent to either end of a flow, whichever side of a flow they are on. The adapter names both ends by nation."""
    from flowloom.plans import detect

    hit = (F.col("port") < 200) & ~F.col("reverse_seen")
    f = t.flows(spark, sf).withColumns({"src_ip": (F.col("src") % 25).cast("string"), "dst_ip": F.col("dst").cast("string")})
    f = f.withColumns({"victim": F.when(hit, F.when(F.col("port") < 128, F.col("dst_ip")).otherwise(F.col("src_ip"))), "victim_bytes": F.when(hit, F.col("bytes")), "victim_packets": F.when(hit, F.col("packets"))})
    got = detect.reflection(f, "ord", "last", WINDOW)
    return got.join(f.select("ord", *KEYS), "ord").select(*KEYS, "end", "reflector_flows", rounded("reflector_bytes", 2), F.round(F.col("reflector_mean_pkt") + 1e-9, 3).alias("reflector_mean_pkt"))


@query(
    f"""SELECT w, 'dst' AS scope, dst AS entity, 'RULE_FAST_SYN_FLOOD' AS rule FROM (SELECT w, dst, count(*) AS n, count(*) FILTER (silent) / count(*) AS share FROM
 (SELECT w, dst, src, NOT coalesce(min(seq) FILTER ({SYN}) < max(seq) FILTER ({ACK}), false) AS silent FROM kept GROUP BY w, dst, src HAVING count(*) FILTER ({SYN}) > 0) GROUP BY w, dst) WHERE n >= 2 AND round(share, 6) >= 0.5
UNION ALL SELECT w, 'dst', dst, 'RULE_FAST_UDP_REFLECTION' FROM (SELECT w, dst, count(DISTINCT src) AS n, sum(packet_len) AS b, avg(packet_len) AS m FROM fw r WHERE dst_port < 30
 AND NOT EXISTS (SELECT 1 FROM fw q WHERE q.dst_port >= 70 AND q.src = r.src AND q.dst = r.dst AND q.w IN (r.w, r.w - 1)) GROUP BY w, dst) WHERE n >= 2 AND round(b, 4) >= 50 AND round(m, 4) >= 20
UNION ALL SELECT w, 'src', src::VARCHAR, 'RULE_FAST_SCAN' FROM (SELECT w, src, count(*) AS n, count(*) FILTER (silent) / count(*) AS share FROM
 (SELECT w, src, dst, dst_port, NOT coalesce(min(seq) FILTER ({SYN}) < max(seq) FILTER ({ACK}), false) AS silent FROM fw GROUP BY w, src, dst, dst_port HAVING count(*) FILTER ({SYN}) > 0) GROUP BY w, src) WHERE n >= 2 AND round(share, 6) >= 0.5""",
    t.PKT_SQL,
    f"fw AS (SELECT * REPLACE ('h' || (dst_port % 3) AS dst, src % 40 AS src), floor(ts / {FAST})::BIGINT AS w FROM pkt)",
    f"kept AS (SELECT * FROM (SELECT *, min(seq) FILTER ({OPENS}) OVER (PARTITION BY w, dst) AS first FROM fw) WHERE seq >= first)",
)
def fast_rules_all(spark, sf):
    """The three fast rules, with thresholds that fit the table."""
    p = t.packets(spark, sf).withColumns({"dst": F.concat(F.lit("h"), (F.col("dst_port") % 3).cast("string")), "src": F.col("src") % 40})
    bounds = {"RULE_FAST_SYN_FLOOD": {"srcs": 2, "syn_only": 0.5}, "RULE_FAST_UDP_REFLECTION": {"srcs": 2, "mean_pkt": 20, "bytes": 50}, "RULE_FAST_SCAN": {"targets": 2, "syn_only": 0.5}}
    return fastlane.all_rules(fastlane.per_destination(p, FAST, SYN, ACK, OPENS), fastlane.unsolicited(p, FAST, "dst_port < 30", "dst_port >= 70"), fastlane.per_source(p, FAST, SYN, ACK), bounds)


@query(
    """SELECT w, dst, max(packet_len) - min(packet_len) AS ttl_spread FROM fw WHERE tcp_flags = 2 GROUP BY w, dst""",
    t.PKT_SQL,
    f"fw AS (SELECT * REPLACE (floor(packet_len)::INTEGER AS packet_len), floor(ts / {FAST})::BIGINT AS w FROM pkt)",
)
def fast_ttl_spread(spark, sf):
    return fastlane.ttl_spread(t.packets(spark, sf).withColumn("ttl", F.floor("packet_len").cast("int")), FAST, SYN)


@query(
    f"""SELECT src, seq, ts FROM kept""",
    "RECURSIVE " + t.PKT_SQL,
    f"free AS (SELECT * FROM pkt h WHERE tcp_flags = 2 AND NOT EXISTS (SELECT 1 FROM pkt f WHERE f.src = h.src AND f.tcp_flags = 17 AND f.ts <= h.ts AND h.ts - f.ts < {5 * DAY}))",
    f"""kept AS (SELECT src, arg_min(seq, (ts, seq)) AS seq, min(ts) AS ts FROM free GROUP BY src
  UNION ALL (SELECT k.src, arg_min(p.seq, (p.ts, p.seq)), min(p.ts) FROM kept k JOIN free p ON p.src = k.src AND p.ts - k.ts >= {5 * DAY} GROUP BY k.src, k.seq))""",
)
def provisional_hits(spark, sf):
    """Fast hits that no flow alert told of lately, one per source in a while."""
    p = t.packets(spark, sf)
    fired = p.filter("tcp_flags = 17").select("src", "ts", F.col("ts").alias("fired"))
    return alerts.unreported(p.filter("tcp_flags = 2").select("src", "ts", "seq"), fired, ["src"], ["src"], "ts", "seq", 5 * DAY).select("src", "seq", "ts")


@query("SELECT alert_id, threat_class, severity, host FROM alr WHERE alert_id = 7", t.ALERTS_SQL)
def alert_lookup(spark, sf):
    return alertlog.find(t.alerts(spark, sf), 7).select("alert_id", "threat_class", "severity", "host")


@query("SELECT count(*) AS alerts FROM alr", t.ALERTS_SQL)
def alert_count(spark, sf):
    return alertlog.count(t.alerts(spark, sf))


#: The adapter's classes under the names of threats.
THREATS = {"ERROR": "THREAT_EXFILTRATION", "CLICK": "THREAT_C2_BEACON", "VIEW": "THREAT_DNS_DGA", "SIGNUP": "THREAT_RECON_PORTSCAN"}
_AS_THREATS = "CASE threat_class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in THREATS.items()) + " ELSE threat_class END"
_TACTIC = "CASE c WHEN 'THREAT_EXFILTRATION' THEN 'Exfiltration' WHEN 'THREAT_C2_BEACON' THEN 'Command and Control' WHEN 'THREAT_DNS_DGA' THEN 'Command and Control' WHEN 'THREAT_RECON_PORTSCAN' THEN 'Discovery' ELSE 'Unclassified' END"
THREAT_SQL = [t.ALERTS_SQL, f"thr AS (SELECT *, {_TACTIC} AS tactic FROM (SELECT *, {_AS_THREATS} AS c FROM alr))"]


def _threats(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in THREATS.items() for x in kv])
    return t.alerts(spark, sf).withColumn("threat_class", F.coalesce(F.try_element_at(m, F.col("threat_class")), F.col("threat_class")))


@query(
    f"""SELECT campaign_id, alerts, first_seen, last_seen, {_NAMED.format('rank')} AS severity, hosts, classes, tactics FROM
(SELECT campaign_id, count(*) AS alerts, min(ts) AS first_seen, max(ts) AS last_seen, max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS rank FROM lat GROUP BY 1)
JOIN (SELECT campaign_id, string_agg(host::VARCHAR, ',' ORDER BY f) AS hosts FROM (SELECT campaign_id, host, min(alert_id) AS f FROM lat GROUP BY 1, 2) GROUP BY 1) USING (campaign_id)
JOIN (SELECT campaign_id, string_agg(c, ',' ORDER BY f) AS classes FROM (SELECT campaign_id, c, min(alert_id) AS f FROM lat GROUP BY 1, 2) GROUP BY 1) USING (campaign_id)
JOIN (SELECT campaign_id, string_agg(tactic, ',' ORDER BY f) AS tactics FROM (SELECT campaign_id, tactic, min(alert_id) AS f FROM lat GROUP BY 1, 2) GROUP BY 1) USING (campaign_id)""",
    *THREAT_SQL,
    "lat AS (SELECT * FROM thr WHERE campaign_id IS NOT NULL ORDER BY alert_id DESC LIMIT 5000)",
)
def campaign_summaries(spark, sf):
    """The campaigns of the newest 5,000 alerts that have one: a report's bound."""
    return alertlog.campaign_summaries(_threats(spark, sf))


@query(
    """SELECT h.*, coalesce(campaigns, '') AS campaigns FROM (SELECT host, tactic, c AS threat_class, count(*) AS alerts, min(ts) AS first_seen, max(ts) AS last_seen FROM thr GROUP BY 1, 2, 3) h
LEFT JOIN (SELECT host, c AS threat_class, string_agg(campaign_id, ',' ORDER BY f) AS campaigns FROM (SELECT host, c, campaign_id, min(alert_id) AS f FROM thr WHERE campaign_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (host, threat_class)""",
    *THREAT_SQL,
)
def host_stages(spark, sf):
    return alertlog.host_stages(_threats(spark, sf)).drop("tactic_id")


@query(
    """SELECT conv_id, n AS records, k = 3 OR n < 3 AS ok, CASE WHEN n >= 3 THEN CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 END END::BIGINT AS first_bad,
CASE WHEN n >= 3 THEN CASE k WHEN 0 THEN 'wrong hash' WHEN 1 THEN 'wrong link' WHEN 2 THEN 'column differs' END END AS reason FROM (SELECT conv_id, conv_id % 4 AS k, count(*) AS n FROM log GROUP BY 1)""",
    t.LOG_SQL,
)
def chain_reasons(spark, sf):
    """Chains that were changed at a known place, in one of three ways."""
    rows = t.log(spark, sf).withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).withColumn("kind", F.col("role"))
    made = rows.join(folds.chain(rows, ["conv_id"], _document(), "seq"), ["conv_id", "seq"])
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    at = lambda k, place: (F.col("conv_id") % 4 == k) & (F.col("seq") == place) & (F.col("n") >= 3)
    bad = made.withColumn("n", n).withColumns({"text": F.when(at(0, 2), F.concat("text", F.lit("!"))).otherwise(F.col("text")), "prev_hash": F.when(at(1, 1), F.lit("0" * 64)).otherwise(F.col("prev_hash")), "kind": F.when(at(2, 1), F.lit("?")).otherwise(F.col("kind"))})
    return folds.inspect_chain(bad, ["conv_id"], _document(), "seq", {"kind": F.col("role")}).drop("head")


@query(
    """SELECT event_id, code, CASE code WHEN 'botnet' THEN 1 WHEN 'normal' THEN 0 END AS y FROM (SELECT event_id, CASE WHEN l LIKE 'flow=From-Botnet%' THEN 'botnet' WHEN l LIKE 'flow=From-Normal%' THEN 'normal' WHEN l LIKE 'flow=To-Botnet%' THEN 'to-botnet' WHEN l LIKE 'flow=To-Normal%' THEN 'to-normal' ELSE 'background' END AS code FROM
(SELECT event_id, CASE event_type WHEN 'error' THEN 'flow=From-Botnet-V1' WHEN 'view' THEN 'flow=From-Normal-V2' WHEN 'click' THEN 'flow=To-Botnet' WHEN 'signup' THEN 'flow=To-Normal-X' ELSE 'flow=Background' END AS l FROM events))""",
)
def label_codes(spark, sf):
    names = {"error": "flow=From-Botnet-V1", "view": "flow=From-Normal-V2", "click": "flow=To-Botnet", "signup": "flow=To-Normal-X"}
    said = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type")), F.lit("flow=Background"))
    code = evaluate.label_code(said)
    return t.read(spark, sf, "events").select("event_id", code.alias("code"), evaluate.train_label(code).alias("y"))


OUTCOMES_SQL = [
    t.PKT_SQL,
    """lab AS (SELECT dst_port || '-' || (src % 7) AS flow_id, ts AS start, CASE WHEN packet_len < 30 THEN 'botnet' WHEN packet_len < 60 THEN 'normal' ELSE 'to-normal' END AS code FROM pkt WHERE tcp_flags = 16),
ale AS (SELECT seq AS alert_id, dst AS detector, dst_port || '-' || (src % 7) AS "trigger", ts AS start, seq % 3 <> 0 AS by_rule, (src % 50)::VARCHAR AS "first", (src % 31)::VARCHAR AS "second" FROM pkt WHERE tcp_flags <> 16),
by_flow AS (SELECT a.alert_id, arg_min(l.code, (l.start, l.code)) AS code FROM ale a JOIN lab l ON l.flow_id = a."trigger" AND abs(l.start - a.start) <= 40000 AND l.code IN ('botnet', 'normal') GROUP BY 1),
outc AS (SELECT a.*, b.code, by_rule AND ("first"::INTEGER < 5 OR "second"::INTEGER < 5) AS bad, by_rule AND ("first"::INTEGER BETWEEN 10 AND 19 OR "second"::INTEGER BETWEEN 10 AND 19) AS good FROM ale a LEFT JOIN by_flow b USING (alert_id)),
said AS (SELECT alert_id, detector, CASE WHEN code = 'botnet' THEN 'tp' WHEN code = 'normal' THEN 'fp' WHEN bad THEN 'tp' WHEN good THEN 'fp' ELSE 'unknown' END AS outcome, CASE WHEN code IS NOT NULL THEN 'flow' WHEN bad OR good THEN 'entity' ELSE '-' END AS via FROM outc)""",
]


def _outcomes(spark, sf):
    p = t.packets(spark, sf).withColumn("flow_id", F.concat_ws("-", "dst_port", (F.col("src") % 7).cast("string")))
    code = F.when(F.col("packet_len") < 30, "botnet").when(F.col("packet_len") < 60, "normal").otherwise("to-normal")
    labels = p.filter("tcp_flags = 16").select("flow_id", F.col("ts").alias("start"), code.alias("code"))
    ip = lambda n: (F.col("src") % n).cast("string")
    raised = p.filter("tcp_flags <> 16").select(F.col("seq").alias("alert_id"), F.col("dst").alias("detector"), F.col("flow_id").alias("trigger"), F.col("ts").alias("start"), (F.col("seq") % 3 != 0).alias("by_rule"), ip(50).alias("first"), ip(31).alias("second"))
    ips = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("ip"))
    return evaluate.alert_outcomes(raised, labels, ips(0, 5), ips(10, 20), 40000.0)


@query("SELECT * FROM said", *OUTCOMES_SQL)
def alert_outcomes(spark, sf):
    return _outcomes(spark, sf).select("alert_id", "detector", "outcome", "via")


@query(
    """SELECT detector, count(*) AS alerts, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'unknown') AS "unknown",
count(*) FILTER (outcome = 'tp' AND via = 'flow') AS tp_flow, count(*) FILTER (outcome = 'tp' AND via = 'entity') AS tp_entity, count(*) FILTER (outcome = 'fp' AND via = 'flow') AS fp_flow, count(*) FILTER (outcome = 'fp' AND via = 'entity') AS fp_entity,
round((count(*) FILTER (outcome = 'tp')) / nullif(count(*) FILTER (outcome IN ('tp', 'fp')), 0), 4) AS precision_known, round((count(*) FILTER (outcome = 'unknown')) / count(*), 4) AS unknown_share, round(count(*) * 10000.0::DOUBLE / 5000, 2) AS per_10k_flows FROM said GROUP BY 1""",
    *OUTCOMES_SQL,
)
def precision_known(spark, sf):
    return evaluate.precision_known(_outcomes(spark, sf), "detector", 5000)


@query('SELECT "group", score::DOUBLE AS threshold FROM (SELECT "group", score, row_number() OVER (PARTITION BY "group" ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY "group") AS n FROM lab WHERE y = 0) WHERE r = least(floor(n * CASE WHEN n * 0.001 < 3 THEN 3 / n ELSE 0.001 END + 1e-9), n - 1) + 1', t.LAB_SQL)
def budget_widened(spark, sf):
    """An alert budget that few rows cannot tell: it widens to 3 rows."""
    return evaluate.budget_threshold(t.labelled(spark, sf), "group", "y", "score", 0.001, 3.0)


NAMED_SQL = f"""nam AS (SELECT page_id, qname, split_part(qname, '.', 2) AS client, page_id // 50 AS wid, round(coalesce((SELECT entropy(c) FROM (SELECT unnest(string_split(split_part(qname, '.', 1), '')) AS c)), 0), 9) >= 2.0 AS high FROM qnm)"""


@query(
    """SELECT n.page_id, count(*) AS queries_w, count(DISTINCT o.qname) AS names_w, count(*) FILTER (o.high) AS high_w, sum(length(o.qname))::BIGINT AS length_w, round((count(*) FILTER (o.page_id % 5 < 2)) / nullif(count(*) FILTER (o.page_id % 2 = 0), 0), 6) AS nxdomain_w
FROM nam n JOIN nam o ON o.client = n.client AND (o.wid = n.wid - 1 OR (o.wid = n.wid AND o.page_id <= n.page_id)) GROUP BY n.page_id""",
    t.NAMES_SQL,
    NAMED_SQL,
)
def dns_windows(spark, sf):
    """What a client asked in a window and the one before, as of each name: queries, different names, those of high entropy, lengths,
    refusals over answers."""
    q = t.names(spark, sf)
    parts = F.split("qname", r"\.")
    q = q.withColumns({"client": F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), "high": (F.round(text.entropy(text.first_label("qname")), 9) >= 2.0).cast("long")})
    sums = {"queries_w": F.lit(1), "high_w": F.col("high"), "length_w": F.length("qname"), "nx": (F.col("page_id") % 5 < 2).cast("long"), "answered": (F.col("page_id") % 2 == 0).cast("long")}
    run = rollups.running_all(q, ["client"], sums, {"names_w": "qname"}, time="page_id", width=50.0, order="page_id")
    return run.select("page_id", "queries_w", "names_w", "high_w", "length_w", F.round(F.try_divide("nx", "answered"), 6).alias("nxdomain_w"))


@query("SELECT f.ok, f.ln, f.pk, f.src, count(*) AS pair_flows_w FROM f JOIN f o ON o.src = f.src AND o.dst = f.dst AND (o.wid = f.wid - 1 OR (o.wid = f.wid AND " + ORD + ")) GROUP BY ALL", FLW_W)
def pair_windows(spark, sf):
    return rollups.running_sums(t.flows(spark, sf), ["src", "dst"], {"pair_flows_w": F.lit(1)}, width=WINDOW).select(*KEYS, "pair_flows_w")


@query(
    """SELECT w, ip FROM (SELECT w, ip, row_number() OVER (PARTITION BY w ORDER BY max(n) DESC, ip) AS r FROM (SELECT dst AS ip, unnest([wid, wid + 1]) AS w, n FROM (SELECT dst, wid, max(n) AS n FROM lt GROUP BY 1, 2) WHERE n >= 5) GROUP BY w, ip) WHERE r <= 10""",
    FLW_W,
    """lt AS (SELECT *, sum(new) OVER (PARTITION BY dst ORDER BY start, ok, ln, pk, src ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY dst, src ORDER BY start, ok, ln, pk) = 1 THEN 1 ELSE 0 END AS new FROM f))""",
)
def fan_in_top(spark, sf):
    """The destinations with the highest fan-in, by window."""
    f = rollups.longterm_distinct(t.flows(spark, sf), ["dst"], "src", "n")
    return correlate.top_fan_in(f.select(F.col("dst").alias("ip"), "n", "last"), WINDOW, time="last")


FIELDS_SQL = """SELECT src, dst, session, round(greatest(max(ts) - min(ts), 0), 4) AS duration, count(*) AS total_packets, sum(len)::BIGINT AS total_bytes, round(count(*) / CASE WHEN max(ts) > min(ts) THEN max(ts) - min(ts) ELSE 1 END, 6) AS pps, round(sum(len) / CASE WHEN max(ts) > min(ts) THEN max(ts) - min(ts) ELSE 1 END, 6) AS bps,
min(len) AS pkt_size_min, max(len) AS pkt_size_max, round(avg(len) + 1e-9, 4) AS pkt_size_mean, round(stddev_pop(len), 4) AS pkt_size_std, round(quantile_cont(len, 0.25) + 1e-9, 4) AS pkt_size_q25, round(quantile_cont(len, 0.5) + 1e-9, 4) AS pkt_size_q50, round(quantile_cont(len, 0.75) + 1e-9, 4) AS pkt_size_q75,
round(coalesce(avg(gap), 0) + 1e-9, 3) AS iat_mean, round(coalesce(max(gap), 0), 4) AS iat_max, round(coalesce(min(gap), 0), 4) AS iat_min, round(stddev_pop(len) / (avg(len) + 1e-6), 5) AS burstiness_ratio, round((count(*) FILTER (len < 64)) / count(*), 6) AS small_pkt_ratio,
1.0::DOUBLE AS is_tcp, 0.0::DOUBLE AS is_icmp, bit_or(tcp_flags) & 2 <> 0 AS has_syn, bit_or(tcp_flags) & 1 <> 0 AS has_fin, bit_or(tcp_flags) & 4 <> 0 AS has_rst,
count(DISTINCT name) AS dns_query_count, round(max((SELECT entropy(c) FROM (SELECT unnest(string_split(name, '')) AS c))), 6) AS dns_max_domain_entropy, max(length(name) - length(replace(name, '.', ''))) AS dns_max_subdomain_depth
FROM (SELECT *, floor(packet_len)::INTEGER AS len, dst || '.' || (dst_port % 3) || '.x' AS name FROM ses) GROUP BY src, dst, session"""


@query(FIELDS_SQL, t.PKT_SQL, SESSIONS_SQL)
def flow_fields(spark, sf):
    """The fields of a flow's own, from aggregates as flow assembly makes them."""
    s = sessions(spark, sf).withColumns({"len": F.floor("packet_len").cast("int"), "name": F.concat("dst", F.lit("."), (F.col("dst_port") % 3).cast("string"), F.lit(".x"))})
    size = F.col("len").cast("double")
    f = s.groupBy("src", "dst", "session").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("last_time"), F.count(F.lit(1)).alias("packet_count"), F.sum("len").alias("total_bytes"), F.min(size).alias("pkt_size_min"), F.max(size).alias("pkt_size_max"), F.avg(size).alias("pkt_size_mean"), F.stddev_pop(size).alias("pkt_size_std"),
        F.percentile(size, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("pkt_size_q"), *[F.coalesce(a("gap"), F.lit(0.0)).alias(f"flow_iat_{n}") for n, a in (("mean", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max))],
        F.lit(0.0).alias("jitter"), F.count_if(size < 64).alias("small_packets"), F.bit_or("tcp_flags").alias("tcp_flags_seen"), F.collect_set("name").alias("dns_queries"), F.first("dst_port").alias("dst_port"),
    ).withColumns({"protocol": F.lit("TCP"), "tls_snis": F.array().cast("array<string>")})
    x = tier1.flow_fields(f)
    r = lambda c, d, e=0.0: F.round(F.col(c) + e, d).alias(c)
    flag = lambda c: (F.col(c) > 0).alias(c)
    return x.select(
        "src", "dst", "session", r("duration", 4), F.col("total_packets").cast("long").alias("total_packets"), F.col("total_bytes").cast("long").alias("total_bytes"), r("pps", 6), r("bps", 6), F.col("pkt_size_min").cast("int").alias("pkt_size_min"), F.col("pkt_size_max").cast("int").alias("pkt_size_max"),
        *[r(c, 4, 1e-9) for c in ("pkt_size_mean", "pkt_size_q25", "pkt_size_q50", "pkt_size_q75")], r("pkt_size_std", 4), r("iat_mean", 3, 1e-9), r("iat_max", 4), r("iat_min", 4), r("burstiness_ratio", 5), r("small_pkt_ratio", 6), "is_tcp", "is_icmp", flag("has_syn"), flag("has_fin"), flag("has_rst"),
        F.col("dns_query_count").cast("long").alias("dns_query_count"), r("dns_max_domain_entropy", 6), F.col("dns_max_subdomain_depth").cast("long").alias("dns_max_subdomain_depth"),
    )


# Captures: events as packets between made-up hosts.

ADDRESSED_SQL = """adr AS (SELECT seq, ts, '10.' || (src % 4) || '.0.' || (src % 200) AS src_ip, CASE dst_port % 3 WHEN 0 THEN '93.184.0.' ELSE '192.168.1.' END || dst_port AS dst_ip, CASE WHEN seq % 5 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
  (1024 + seq % 5000)::INTEGER AS src_port, (dst_port * 7 + 1)::INTEGER AS dst_port, tcp_flags, floor(packet_len)::INTEGER + 60 AS packet_len FROM pkt)"""


def _addressed(spark, sf):
    p, s = t.packets(spark, sf), lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return p.select(
        "seq", "ts", F.concat(F.lit("10."), s(F.col("src") % 4), F.lit(".0."), s(F.col("src") % 200)).alias("src_ip"), F.concat(F.when(F.col("dst_port") % 3 == 0, "93.184.0.").otherwise("192.168.1."), s("dst_port")).alias("dst_ip"), F.when(F.col("seq") % 5 == 0, "UDP").otherwise("TCP").alias("protocol"),
        (1024 + F.col("seq") % 5000).cast("int").alias("src_port"), (F.col("dst_port") * 7 + 1).cast("int").alias("dst_port"), "tcp_flags", (F.floor("packet_len").cast("int") + 60).alias("packet_len"),
    )


@query(
    """SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, round(ts, 6) AS ts, src_ip, dst_ip, protocol, src_port, dst_port, CASE WHEN protocol = 'TCP' THEN tcp_flags END AS tcp_flags, packet_len, 64 AS ttl, 4 AS ip_version FROM adr""",
    t.PKT_SQL,
    ADDRESSED_SQL,
)
def capture_round_trip(spark, sf):
    """Packets written as captures and decoded again."""
    import uuid

    from flowloom.sources import pcap
    from flowloom.staging import folder

    path = f"{folder(spark)}/captures-{uuid.uuid4().hex}"
    pcap.write_captures(_addressed(spark, sf), path)
    got = pcap.read_captures(spark, path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # its packets are staged
    return got.select("seq", rounded("ts"), "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "tcp_flags", "packet_len", "ttl", "ip_version")


@query("SELECT count(*) AS packets, sum(packet_len)::BIGINT AS wire_bytes, count(*) FILTER (packet_len > 100) AS truncated, round(max(ts) - min(ts), 6) AS span FROM adr", t.PKT_SQL, ADDRESSED_SQL)
def capture_facts(spark, sf):
    from flowloom.sources import pcap

    return pcap.capture_facts(_addressed(spark, sf).withColumn("captured_len", F.least("packet_len", F.lit(100)))).withColumn("span", F.round("span", 6))


@query("SELECT seq, src_ip, dst_ip FROM adr WHERE dst_ip LIKE '93.%'", t.PKT_SQL, ADDRESSED_SQL)
def one_way_packets(spark, sf):
    from flowloom.sources import pcap

    return pcap.one_way(_addressed(spark, sf), "OUT").select("seq", "src_ip", "dst_ip")


@query(
    """SELECT seq, '1:' || to_base64(unhex(sha1(unhex('0000' || CASE WHEN swap THEN b || a ELSE a || b END || p || '00' || CASE WHEN swap THEN printf('%04X%04X', dst_port, src_port) ELSE printf('%04X%04X', src_port, dst_port) END)))) AS flow_id FROM
(SELECT *, a > b OR (a = b AND src_port > dst_port) AS swap, CASE protocol WHEN 'TCP' THEN '06' ELSE '11' END AS p FROM
 (SELECT *, (SELECT string_agg(printf('%02X', x::INTEGER), '' ORDER BY i) FROM (SELECT unnest(string_split(src_ip, '.')) AS x, unnest(range(4)) AS i)) AS a, (SELECT string_agg(printf('%02X', x::INTEGER), '' ORDER BY i) FROM (SELECT unnest(string_split(dst_ip, '.')) AS x, unnest(range(4)) AS i)) AS b FROM adr))""",
    t.PKT_SQL,
    ADDRESSED_SQL,
)
def community_ids(spark, sf):
    return _addressed(spark, sf).select("seq", network.community_id("protocol", "src_ip", "dst_ip", "src_port", "dst_port").alias("flow_id"))


@query(
    """SELECT seq, protocol || '~' || least(a, b) || '~' || greatest(a, b) AS label_key FROM (SELECT seq, lower(protocol) AS protocol, src_ip || '|' || src_port AS a, dst_ip || '|' || dst_port AS b FROM adr)""",
    t.PKT_SQL,
    ADDRESSED_SQL,
)
def label_keys(spark, sf):
    """Keys that a flow and its label share whichever way they face; one side's ports are hexadecimal here."""
    from flowloom.sources import logs

    a = _addressed(spark, sf).withColumn("dport", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("dst_port")), 4, "0")))
    return a.select("seq", logs.label_key("protocol", "src_ip", "src_port", "dst_ip", "dport").alias("label_key"))


@query(
    """SELECT seq, md5('771,' || list_aggregate(cs, 'string_agg', '-') || ',0-10-' || e || ',29-23,0') AS ja3, md5('771,' || c1 || ',43-' || e) AS ja3s,
't13d0' || len(cs) || '03' || 'h2_' || substr(sha256(list_aggregate(list_sort(list_transform(cs, lambda x: printf('%04x', x))), 'string_agg', ',')), 1, 12) || '_' || substr(sha256(list_aggregate(list_sort(['000a', printf('%04x', e)]), 'string_agg', ',') || '_0403,0804'), 1, 12) AS ja4
FROM (SELECT seq, c1, e, list_filter([2570, c1, c2], lambda x: x <> 2570) AS cs FROM (SELECT seq, (4865 + seq % 7)::INTEGER AS c1, (49195 + seq % 11)::INTEGER AS c2, (21 + seq % 13)::INTEGER AS e FROM pkt))""",
    t.PKT_SQL,
)
def fingerprints(spark, sf):
    """JA3, JA3S and JA4 of made hellos: reserved values are left out, JA4 sorts."""
    n = lambda base, mod: (F.lit(base) + F.col("seq") % mod).cast("int")
    p = t.packets(spark, sf).select("seq", n(4865, 7).alias("c1"), n(49195, 11).alias("c2"), n(21, 13).alias("e"))
    p = p.withColumns({"v": F.lit(771), "best": F.lit(0x0304), "alpn": F.lit("h2"), "c": F.array(F.lit(0x0A0A), "c1", "c2"), "x": F.array(F.lit(0), F.lit(0x1A1A), F.lit(10), "e"), "sx": F.array(F.lit(43), "e"), "g": F.array(F.lit(29), F.lit(0x2A2A), F.lit(23)), "f": F.array(F.lit(0)), "s": F.array(F.lit(0x0403), F.lit(0x0804))})
    return p.select("seq", text.ja3("v", "c", "x", "g", "f").alias("ja3"), text.ja3s("v", "c1", "sx").alias("ja3s"), text.ja4("best", "alpn", "c", "x", "s").alias("ja4"))
