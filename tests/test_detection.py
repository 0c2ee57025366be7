import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import alerts as al
from flowloom.operators import contract, correlate, evaluate, folds, ml, tier1
from flowloom.operators.rules import EVIDENCE, fuse
from flowloom.plans import detect
from flowloom.sources import logs, pcap
from tests import captures as c

R = random.Random(9)
INSIDE, OUTSIDE = "10.0.0.5", "93.184.216.34"


def session(t, src, dst, sport, dport, up=1, down=1, size=200, hello=b""):
    rows = [(t, c.tcp(src, dst, sport, dport, 2)), (t + 0.01, c.tcp(dst, src, dport, sport, 18)), (t + 0.02, c.tcp(src, dst, sport, dport, 16, hello))]
    rows += [(t + 0.03 + i / 1000, c.tcp(src, dst, sport, dport, 24, b"u" * size)) for i in range(up)]
    rows += [(t + 0.5 + i / 1000, c.tcp(dst, src, dport, sport, 24, b"d" * size)) for i in range(down)]
    return rows + [(t + 0.9, c.tcp(src, dst, sport, dport, 17)), (t + 0.95, c.tcp(dst, src, dport, sport, 17))]


def syn_flood():
    return [(10 + i / 50, c.tcp(f"20.{i % 7}.{i // 200}.{i % 200}", "10.50.0.10", 2000 + i, 80, 2)) for i in range(500)]


def reflection():
    return [(10 + i / 100 + k / 30, c.udp(f"30.0.0.{i}", "10.50.0.11", 123, 4000 + i, b"r" * 1300)) for i in range(150) for k in range(10)]


def beacon():
    return [r for i in range(24) for r in session(100 + 30 * i + R.uniform(-3, 3), INSIDE, OUTSIDE, 3000 + i, 443)]


def sweep():
    return [r for p in range(1, 101) for r in [(50 + p / 20, c.tcp("10.0.0.9", "10.0.0.20", 40000, p, 2)), (50 + p / 20 + 0.001, c.tcp("10.0.0.20", "10.0.0.9", p, 40000, 20))]]


def upload():
    return session(50, "10.0.0.77", "93.184.216.99", 3999, 443, up=900, down=1, size=1400)


def names(answer):
    rows = []
    for i in range(80):
        name = "".join(R.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(18)) + ".example"
        rows.append((100 + i / 4, c.udp(INSIDE, "10.0.0.53", 2000 + i, 53, c.dns(name))))
        if answer:
            rows.append((100.01 + i / 4, c.udp("10.0.0.53", INSIDE, 53, 2000 + i, c.dns(name, True, 3))))
    return rows


def tunnel():
    word = "ab" * 22
    return [(100 + i / 5, c.udp(INSIDE, "10.0.0.53", 2000 + i, 53, c.dns(f"{word}.t.example"))) for i in range(90)]


def browsing():
    rows = [r for i in range(40) for r in session(100 + 7.7 * i + R.uniform(0, 6), f"10.0.0.{i % 5 + 2}", f"93.184.{i % 9}.{i % 7}", 3000 + i, 443, 3, 8, 400, c.client_hello(f"h{i % 6}.example"))]
    return rows + [(100 + i * 5, c.udp(f"10.0.0.{i % 5 + 2}", "10.0.0.53", 5000 + i, 53, c.dns(f"www{i % 6}.example"))) for i in range(40)]


def pings():
    return [(100 + i, c.icmp("10.0.0.2", "10.0.0.3", 8)) for i in range(60)]


CASES = {
    "syn_flood": (syn_flood, {"RULE_DDOS_SYN_FLOOD"}),
    "reflection": (reflection, {"RULE_DDOS_UDP_REFLECTION"}),
    "beacon": (beacon, {"RULE_C2_PERIODIC_FLOWS"}),
    "sweep": (sweep, {"RULE_RECON_FANOUT_SYN_ONLY"}),
    "upload": (upload, {"RULE_EXFIL_OUTBOUND_RATIO"}),
    "names_refused": (lambda: names(True), {"RULE_DGA_NXDOMAIN_HIGH_ENTROPY"}),
    "names_unanswered": (lambda: names(False), {"RULE_DGA_HIGH_ENTROPY_QNAMES"}),
    "tunnel": (tunnel, {"RULE_DNS_TUNNEL_VOLUME_LENGTH"}),
    "browsing": (browsing, set()),
    "pings": (pings, set()),
}


def test_each_attack_gives_its_alert_once_and_benign_traffic_none(spark, tmp_path):
    """All scenes in one capture, hours apart."""
    rows = [(t + 20_000.0 * i, data) for i, (make, _) in enumerate(CASES.values()) for t, data in make()]
    (tmp_path / "x.pcap").write_bytes(c.classic(sorted(rows, key=lambda r: r[0])))
    alerts = detect.detect(pcap.read_captures(spark, str(tmp_path))).collect()
    found = {name: sorted(a.rules for a in alerts if a.last_time // 20_000 == i) for i, name in enumerate(CASES)}
    assert found == {name: sorted(rules) for name, (_, rules) in CASES.items()}
    assert all(a.flow_id.startswith("1:") for a in alerts)


def test_alerts_are_records_from_capture_to_log(spark, tmp_path):
    """Three scenes hours apart: a flood that the fast lane sees first, a sweep, and an upload; then the log, its chain and its export."""
    scenes = {"flood": syn_flood, "sweep": sweep, "upload": upload}
    rows = [(t + 20_000.0 * i, data) for i, make in enumerate(scenes.values()) for t, data in make()]
    (tmp_path / "x.pcap").write_bytes(c.classic(sorted(rows, key=lambda r: r[0])))
    made = detect.alerts(pcap.read_captures(spark, str(tmp_path)))
    got = {name: [a for a in made.collect() if a.ts // 20_000 == i] for i, name in enumerate(scenes)}
    flood = {a.provisional: a for a in got["flood"]}
    assert len(got["flood"]) == 2 and flood[False].rule_matches == ["RULE_DDOS_SYN_FLOOD"] and flood[True].rule_matches == ["RULE_FAST_SYN_FLOOD"]
    assert flood[False].confirms == flood[True].alert_id and flood[True].confirms is None
    assert flood[False].flow_id.startswith("win:dst:10.50.0.10:0:60") and flood[True].flow_id == "win:dst:10.50.0.10:10:1"
    assert flood[False].contributing_flows[0] == flood[False].trigger and len(flood[False].contributing_flows) == len(flood[True].contributing_flows) == 5
    told = {e.feature: (e.value, e.baseline) for e in flood[False].evidence}
    assert told["dst_distinct_srcs_w"][0] >= 200 and told["dst_distinct_srcs_w"][1] == 200 and told["dst_syn_only_ratio_w"] == (1.0, 0.8)
    assert flood[True].evidence and {e.feature for e in flood[True].evidence} >= {"fl_dst_syn_srcs_1s", "fl_dst_ttl_spread_1s"} and flood[True].observability_state is None
    sweep_ = [a for a in got["sweep"] if not a.provisional]
    assert [a.rule_matches for a in sweep_] == [["RULE_RECON_FANOUT_SYN_ONLY"]] and sweep_[0].flow_id.startswith("win:src:10.0.0.9:") and sweep_[0].tactic == "Discovery"
    (out,) = got["upload"]
    assert (out.threat_class, out.severity, out.detector.type, out.host, out.tactic_id) == ("THREAT_EXFILTRATION", "HIGH", "RULE", "10.0.0.77", "TA0010")
    assert out.flow_id.startswith("1:") and out.contributing_flows is None and out.campaign_id.startswith("camp-") and out.timestamp.endswith("+00:00")
    assert out.feature_summary.total_packets > 900 and out.metrics["egress_bytes"] > 1_000_000 and out.flow.dst_ip == "93.184.216.99"
    # the log: chained, grown by a second batch, whole, exported
    documents = made.select("alert_id", "ts", F.to_json(F.struct("alert_id", "severity", "threat_class")).alias("document"))
    path = str(tmp_path / "log")
    first = documents.orderBy("ts", "alert_id").limit(2)
    assert logs.append_chained(spark, first, path) == 2
    assert logs.append_chained(spark, documents.join(first.select("alert_id"), "alert_id", "left_anti"), path) == documents.count() - 2
    log = spark.read.parquet(path).drop("from")
    whole = folds.inspect_chain(log.withColumn("l", F.lit(1)), ["l"], F.col("document"), "seq").first()
    assert (whole.records, whole.ok, whole.reason) == (documents.count(), True, None)
    with pytest.raises(ValueError):
        logs.append_chained(spark, first, path)
    facts = logs.export_log(log, str(tmp_path / "out"))
    assert facts["chain_head"] == whole.head and facts["records"] == whole.records
    assert (tmp_path / "out/chain_head.txt").read_text().strip() == whole.head and "sha256" in (tmp_path / "out/manifest.json").read_text()
    cut = folds.inspect_chain(log.filter("seq <> 1").withColumn("l", F.lit(1)), ["l"], F.col("document"), "seq").first()
    assert (cut.ok, cut.first_bad, cut.reason, cut.head) == (False, 1, "sequence gap", None)


def test_reflection_names_the_victim_at_either_end(spark, tmp_path):
    """Flows that a victim's own packet opened are solicited; those cut by age keep their first orientation, so that the reflector may be
    their destination."""
    rows = [(0.0 + i / 100, c.udp("10.50.0.11", f"30.0.{i // 200}.{i % 200}", 4000, 123, b"q")) for i in range(60)]
    rows += [(t + i / 100, c.udp(f"30.0.{i // 200}.{i % 200}", "10.50.0.11", 123, 4000, b"r" * 1300)) for i in range(60) for t in (5.0, 15.0, 25.0, 35.0, 45.0, 55.0, *(65.0 + k / 2 for k in range(20)))]
    (tmp_path / "x.pcap").write_bytes(c.classic(sorted(rows, key=lambda r: r[0])))
    f = detect.prepared(pcap.read_captures(spark, str(tmp_path)))
    got = {r.chunk: r for r in f.groupBy("chunk").agg(F.max("src_reflector_flows_w").alias("at_src"), F.max("dst_reflector_flows_w").alias("at_dst"), F.first("src_ip").alias("src"), F.count("victim").alias("victims")).collect()}
    assert got[0].victims == 0 and got[1].victims == 60 and (got[1].src, got[1].at_src, got[1].at_dst) == ("10.50.0.11", 60, 0)
    alerts = detect.detect(pcap.read_captures(spark, str(tmp_path))).collect()
    assert [(a.rules, a.entity) for a in alerts if "REFLECTION" in a.rules] == [("RULE_DDOS_UDP_REFLECTION", "10.50.0.11")]


def test_rules_read_what_the_contract_says(spark):
    """Each detector's predicates refer to features that it declares, and to all of them."""
    spec = contract.Contract.load()
    assert len(spec.features) > 80 and spec.version
    reads = {}
    for r in detect.ruleset():
        told = contract.columns_of(r.when, *r.evidence)
        reads.setdefault(r.detector, set()).update(told & set(spec.features))
    for detector, names in reads.items():
        assert [v for v in spec.violations(detector, sorted(names)) if "no feature" not in v] == [], detector


def test_model_rows_and_trees(spark, tmp_path):
    rows = [r for i in range(30) for r in session(10.0 + 20 * i, f"10.0.0.{i % 7 + 2}", OUTSIDE, 3000 + i, 443, up=i % 5 + 1, down=i % 3)]
    (tmp_path / "x.pcap").write_bytes(c.classic(sorted(rows, key=lambda r: r[0])))
    f = detect.prepared(pcap.read_captures(spark, str(tmp_path)))
    x = tier1.model_row(f, ["ord"])
    assert x.columns == ["ord", *tier1.MODEL_ROW] and len(tier1.MODEL_ROW) == 65 and len(tier1.LEARNED) == 48 and x.count() == f.count() == 30
    one = x.orderBy("ord").first()
    assert one.dst_bytes_vs_baseline is None and one.pair_history_count == 1 and one.is_tcp == 1.0 and one.dst_port_class == 1.0
    # out of fold: a group is scored by the others; contributions tell what moved a score
    r = random.Random(1)
    table = spark.createDataFrame([(i, f"g{i % 3}", r.random(), r.random(), i) for i in range(300)], "ord long, g string, a double, b double, n long").withColumn("y", (F.col("a") > 0.6).cast("int"))
    inputs = ["a", "b"]
    got = ml.out_of_fold(table, inputs, "y", "g", maxIter=5, maxDepth=3, minInstancesPerNode=5)
    scored = {s.ord: s.probability for s in got.collect()}
    right = [(scored[t.ord] > 0.5) == bool(t.y) for t in table.collect()]
    assert len(scored) == 300 and sum(right) > 280
    one_sided = table.withColumn("y", F.when(F.col("g") == "g0", F.col("y")).otherwise(F.lit(0)))
    assert {s.g for s in ml.out_of_fold(one_sided, inputs, "y", "g", maxIter=2, maxDepth=2, minInstancesPerNode=5).collect()} == {"g1", "g2"}
    model = ml.fit_trees(table, inputs, "y", maxIter=5, maxDepth=3, minInstancesPerNode=5)
    told = {t.ord: t.contributions for t in ml.contributions(table.limit(20), model, inputs, "ord").collect()}
    assert all(t[0].feature == "a" and (t[0].contribution > 0) == (t[0].value > 0.6) for t in told.values())
    with pytest.raises(ValueError):
        ml.fit_trees(table.withColumnRenamed("a", "src_ip"), ["src_ip", "b"], "y")
    # a model's word: it raises what it agrees with, and alone makes MEDIUM at most
    scores = f.select("ord", F.lit(0.95).alias("score"), F.lit(0.95).alias("probability"), F.array().cast(EVIDENCE).alias("contributions")).limit(1)
    empty = fuse(detect.flow_hits(f), [*detect.FLOW, "threat_class"])
    (alone,) = al.assemble(empty, f, 60.0, ml.flagged(scores, 0.9, "trees", "THREAT_ML_MALICIOUS_FLOW", True)).collect()
    assert (alone.severity, alone.confidence, alone.detector.type, alone.ml_scores, alone.rule_matches) == ("MEDIUM", 0.95, "ML", [0.95], [])
    assert al.assemble(empty, f, 60.0, ml.flagged(scores, 0.95, "trees", "X", True)).count() == 0 and al.assemble(empty, f, 60.0, ml.flagged(scores, 0.9, "trees", "X", False)).count() == 0


def test_campaigns_leave_common_infrastructure_out(spark, tmp_path):
    rows = []
    for i in range(12):  # a resolver that many ask, and a server that one calls
        rows += [(5.0 * i, c.udp(f"10.0.0.{i + 10}", "10.0.0.53", 2000 + i, 53, c.dns(f"n{i}.example"))), (5.0 * i + 0.1, c.udp("10.0.0.53", f"10.0.0.{i + 10}", 53, 2000 + i, c.dns(f"n{i}.example", True)))]
    rows += session(70, "10.0.0.10", OUTSIDE, 3000, 443)
    (tmp_path / "x.pcap").write_bytes(c.classic(sorted(rows, key=lambda r: r[0])))
    f = detect.prepared(pcap.read_captures(spark, str(tmp_path)))
    got = {p.host: p for p in correlate.flow_pivots(correlate.refusals(f, 60.0)).join(f.select("ord", "dst_ip"), "ord").orderBy("ord").collect() if p.dst_ip == "10.0.0.53"}
    assert got["10.0.0.11"].refused == [] and got["10.0.0.21"].refused == ["dst:10.0.0.53", "port:UDP/1"] and got["10.0.0.21"].refused_why == "shared resolver 10.0.0.53"
    assert got["10.0.0.21"].pivots == ["host:10.0.0.21", "dst:10.0.0.53", "port:UDP/1", "name:n11.example"]
    alerts = [(1, 0.0, ["host:a", "dst:r"], [], None), (2, 10.0, ["host:b", "dst:r"], ["dst:r"], "shared resolver r"), (3, 20.0, ["host:b", "dst:s"], [], None)]
    df = spark.createDataFrame(alerts, "alert_id long, ts double, pivots array<string>, refused array<string>, refused_why string")
    got = {r.alert_id: r for r in correlate.join_campaigns(df).collect()}
    assert got[1].campaign_id != got[2].campaign_id == got[3].campaign_id and got[3].joined_on == ["host:b"]
    assert got[2].not_merged == [f"{got[1].campaign_id}: not merged: shared resolver r"]


def test_one_way_table(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(c.classic(sorted(upload(), key=lambda r: r[0])))
    table = evaluate.one_way_table(pcap.read_captures(spark, str(tmp_path)), detect.detect)
    assert {r.threat_class: (r.both, r.inward, r.outward) for r in table.collect()} == {"THREAT_EXFILTRATION": (1, 0, 0)}


def test_log_sinks(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, f"doc {i}") for i in range(5)], "alert_id long, document string")
    assert logs.append_alerts(spark, rows, path) == 5
    with pytest.raises(ValueError):
        logs.append_alerts(spark, rows.limit(1), path)
    with pytest.raises(ValueError):
        logs.append_alerts(spark, rows.withColumn("alert_id", F.lit(77)), path)
    log = rows.withColumn("seq", F.col("alert_id")).withColumn("l", F.lit(1))
    chained = log.join(folds.chain(log, ["l"], F.col("document"), "seq"), ["l", "seq"]).drop("l")
    facts = logs.export_log(chained, str(tmp_path / "out"))
    assert facts["records"] == 5 and spark.read.text(str(tmp_path / "out/alerts.jsonl")).count() == 5
    with pytest.raises(ValueError):
        logs.export_log(chained.filter("seq <> 2"), str(tmp_path / "out2"))


def test_lists_labels_bundles(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n10.0.0.0/8 # ours\n\n 1.2.3.4\n")
    assert {r.item for r in logs.read_list(spark, str(tmp_path / "list.txt")).collect()} == {"10.0.0.0/8", "1.2.3.4"}
    assert logs.read_list(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "x.binetflow").write_text("StartTime,Dur,Proto,SrcAddr,Sport,DstAddr,Dport,Label\n2011/08/15 12:00:00.500000,2.0,tcp,10.0.0.2,0x0050,10.0.0.1,1000,flow=A\n2011/01/15 12:00:00.000000,0.0,icmp,10.0.0.2,0x08,10.0.0.1,,flow=B\n")
    got = logs.read_flow_labels(spark, str(tmp_path / "x.binetflow")).orderBy("s").collect()
    assert [(r.s, r.e - r.s) for r in got] == [(1295089200.0, 0.0), (1313402400.5, 2.0)]
    assert got[1].key == "tcp~10.0.0.1|1000~10.0.0.2|80" and got[0].key == "icmp~10.0.0.1|~10.0.0.2|"
    m = logs.bundle_manifest({"a": b"1"}, {"rules": "2"})
    logs.check_bundle(m, {"a": b"1"}, {"rules": "2"})
    for members, versions in (({"a": b"2"}, {"rules": "2"}), ({"a": b"1"}, {"rules": "3"})):
        with pytest.raises(ValueError):
            logs.check_bundle(m, members, versions)
    dump = spark.createDataFrame([(1, 0.1), (2, None)], "id long, x double")
    logs.write_dump(dump, str(tmp_path / "dump"))
    assert sorted(map(tuple, logs.read_dump(spark, str(tmp_path / "dump"), "id long, x double").collect()), key=str) == [(1, 0.1), (2, None)]
