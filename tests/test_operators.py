import math
import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions import text
from flowloom.operators import alertlog, contract, correlate, evaluate, folds, ml, rollups, rules


def test_entropy(spark):
    df = spark.createDataFrame([("",), ("aaaaa",), ("ab",), (None,)], "s string")
    assert [r[0] for r in df.select(text.entropy("s")).collect()] == [0.0, 0.0, 1.0, 0.0]


def test_ewma_matches_a_loop_over_all_buckets(spark):
    r = random.Random(3)
    rows = [(k, b, float(r.randint(0, 50))) for k in "xy" for b in sorted(r.sample(range(60), 20))]
    got = {(g.k, g.b): g for g in folds.ewma_baseline(spark.createDataFrame(rows, "k string, b long, v double"), "k", "b", ["v"]).collect()}
    for k in "xy":
        own = {b: v for kk, b, v in rows if kk == k}
        mean = var = 0.0
        n = 0
        for b in range(min(own), max(own) + 1):
            if b in own:
                g = got[k, b]
                assert g.closed == n and g.v_mean == pytest.approx(mean) and g.v_var == pytest.approx(var)
            d = own.get(b, 0.0) - mean
            mean, var = (own.get(b, 0.0), 0.0) if n == 0 else (mean + 0.1 * d, 0.9 * (var + 0.1 * d * d))
            n += 1


def test_suppression_counts_from_the_last_kept(spark):
    hits = spark.createDataFrame([("d", "e", float(t), t) for t in (0, 100, 299, 300, 500, 599, 600)], "detector string, entity string, ts double, seq long")
    assert [r.seq for r in folds.suppress(hits, ["detector", "entity"], 300.0).orderBy("seq").collect()] == [0, 300, 600]
    free = hits.withColumn("entity", F.lit(None).cast("string"))
    assert rules.dedupe(hits.unionByName(free), 300.0, "ts", "seq").count() == 3 + 7


def test_chain_finds_tampering(spark):
    log = spark.createDataFrame([(1, i, f"doc {i}") for i in range(6)], "k int, seq long, d string")
    made = log.join(folds.chain(log, ["k"], F.col("d"), "seq"), ["k", "seq"])
    whole = folds.verify_chain(made, ["k"], F.col("d"), "seq").first()
    assert (whole.records, whole.first_bad) == (6, None)
    edited = made.withColumn("d", F.when(F.col("seq") == 3, "x").otherwise(F.col("d")))
    assert folds.verify_chain(edited, ["k"], F.col("d"), "seq").first().first_bad == 3
    assert folds.verify_chain(made.filter("seq <> 2"), ["k"], F.col("d"), "seq").first().first_bad == 2
    swapped = made.withColumn("seq", F.when(F.col("seq") == 1, 2).when(F.col("seq") == 2, 1).otherwise(F.col("seq")))
    assert folds.verify_chain(swapped, ["k"], F.col("d"), "seq").first().first_bad == 1


def _flows(spark, n=300, seed=5):
    r = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += r.random() * 10
        rows.append((i, f"s{r.randint(0, 3)}", f"d{r.randint(0, 9)}", t))
    return rows, spark.createDataFrame(rows, "ord long, src string, dst string, last double")


def test_running_rollups_match_a_loop(spark):
    rows, df = _flows(spark)
    x = rollups.running_sums(df, ["src"], {"n": F.lit(1)})
    x = rollups.running_distinct(x, ["src"], {"dsts": "dst"})
    x = rollups.running_entropy(x, ["src"], "dst", "h")
    got = {g.ord: g for g in x.collect()}
    assert len(got) == len(rows)
    for i, s, _, t in rows:
        wid = t // 60
        seen = [d for j, s2, d, t2 in rows if s2 == s and j <= i and (t2 // 60 in (wid - 1, wid))]
        p = [seen.count(d) / len(seen) for d in set(seen)]
        assert (got[i].n, got[i].dsts) == (len(seen), len(set(seen)))
        assert got[i].h == pytest.approx(-sum(q * math.log2(q) for q in p), abs=1e-9)


def test_results_do_not_depend_on_partitions(spark):
    _, df = _flows(spark)
    sums = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        sums.append(sorted(map(tuple, rollups.running_distinct(df, ["src"], {"dsts": "dst"}).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sums[0] == sums[1]


def test_periodicity(spark):
    df = spark.createDataFrame([(i, "a", "b", 30.0 * i) for i in range(10)] + [(99, "a", "c", 1.0)], "ord long, src string, dst string, start double")
    got = {r.ord: r for r in rollups.periodicity(df, ["src", "dst"]).collect()}
    assert (got[9].iat_n, got[9].iat_mean, got[9].iat_cv) == (9, 30.0, 0.0)
    assert (got[1].iat_n, got[1].iat_cv, got[99].iat_n, got[99].iat_mean) == (1, None, 0, None)


def test_rules_and_fusion(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 50, 3), (3, None, 9)], "id long, a int, b int")
    made = [rules.Rule("A", rules.at_least("a", 10), "x", "HIGH", 0.8, F.col("id")), rules.Rule("B", rules.at_least("b", 1), "x", "LOW", 0.5, F.col("id")), rules.Rule("C", rules.at_least("b", 1), "y", "CRITICAL", 0.9, F.col("id"))]
    hits = rules.apply_rules(df, made, ["id"])
    assert sorted((r.id, r.rule) for r in hits.collect()) == [(2, "A"), (2, "C"), (3, "B"), (3, "C")]
    fused = rules.fuse(hits, ["id"])
    assert {r.id: (r.rules, r.severity, r.confidence) for r in fused.collect()} == {2: ("A,C", "CRITICAL", 0.9), 3: ("B,C", "CRITICAL", 0.9)}
    scores = spark.createDataFrame([(1, 0.99), (2, 0.95)], "id long, score double")
    got = {r.id: (r.severity, r.confidence) for r in rules.agree(fused, scores, "id", 0.9, alone=True).collect()}
    assert got == {1: ("MEDIUM", 0.99), 2: ("CRITICAL", 0.95), 3: ("CRITICAL", 0.9)}


def test_campaigns(spark):
    rows = [(1, 0.0, ["host:a", "ja4:x"]), (2, 100.0, ["host:a", "ja4:y"]), (3, 5000.0, ["host:a"]), (4, 5001.0, ["host:z", "port:80"]), (5, 5002.0, ["host:q", "port:80"]), (6, 90000.0, ["host:a", "ja4:x"])]
    df = spark.createDataFrame(rows, "alert_id long, ts double, pivots array<string>")
    got = {r.alert_id: r.campaign_id for r in correlate.join_campaigns(df).collect()}
    assert got[1] == got[2] == got[6] and got[3] != got[1] and got[4] != got[5]
    assert got == {r.alert_id: r.campaign_id for r in correlate.join_campaigns(df.repartition(3)).collect()}


def test_overlap_join(spark):
    flows = spark.createDataFrame([(1, "k", 0.0, 10.0), (2, "k", 100.0, 90000.0), (3, "k", 13.0, 14.0), (4, "m", 0.0, 1.0)], "id long, key string, start double, last double")
    labels = spark.createDataFrame([(1, "k", 11.0, 11.5, "A"), (2, "k", 200.0, 300.0, "A"), (3, "k", 86000.0, 87000.0, "B")], "lid long, key string, s double, e double, code string")
    got = {r.id: (r.state, r.label) for r in evaluate.overlap_join(flows, labels, ["key"]).collect()}
    assert got == {1: ("matched", "A"), 2: ("ambiguous", None), 3: ("unmatched", None), 4: ("unmatched", None)}
    assert {r.code: (r.rows, r.matched) for r in evaluate.coverage(labels, flows, ["key"]).collect()} == {"A": (2, 2), "B": (1, 1)}


def test_contract():
    spec = contract.Contract.parse('features = [{name="a", state="computable", tier="flow"}, {name="b", state="unavailable", tier="flow", reason="no"}, {name="c", state="degraded", tier="host"}]\n[consumers.x]\nmax_state = "computable"\nreads = ["a"]\n')
    assert spec.require("a").tier == "flow"
    with pytest.raises(contract.UnavailableFeature):
        spec.require("b")
    with pytest.raises(KeyError):
        spec.require("zzz")
    assert spec.violations("x", ["a", "c", "other"]) == ["c is not declared", "c is degraded", "other is no feature"]
    assert spec.violations("nobody", ["a"]) == ["nobody is no consumer"]
    with pytest.raises(ValueError):  # a consumer above its own tier
        contract.Contract.parse('features = [{name="a", state="degraded", tier="flow"}]\n[consumers.x]\nmax_state = "computable"\nreads = ["a"]\n')
    with pytest.raises(ValueError):
        contract.Contract.parse('features = [{name="a", state="computable", tier="flow"}, {name="a", state="computable", tier="flow"}]')


def test_search_refuses_and_clamps(spark):
    log = spark.createDataFrame([(i, i, "HIGH", "C") for i in range(5)], "alert_id long, ts long, severity string, threat_class string")
    assert [r.alert_id for r in alertlog.search(log, severity="HIGH", limit=2).collect()] == [4, 3]
    assert alertlog.search(log, limit=0).count() == 1
    with pytest.raises(ValueError):
        alertlog.search(log, severity="WORST")


def test_isolation_forest_prefers_outliers():
    import numpy as np

    r = np.random.default_rng(0)
    rows = np.vstack([r.normal(size=(500, 3)), [[9.0, 9.0, 9.0]]])
    s = ml.IsolationForest(rows, seed=1).score(rows)
    assert s[-1] > np.quantile(s[:-1], 0.99)
    assert (s == ml.IsolationForest(rows, seed=1).score(rows)).all()
    with pytest.raises(ValueError):
        ml.refuse_identity(["bytes", "src_ip"])


def test_folds_of_a_hot_key_are_linear(spark):
    """A key with 300,000 rows: its state is small, and twice the rows take about twice the time."""
    import time

    def rows(n):
        return spark.range(n, numPartitions=4).select(F.lit("k").alias("k"), F.col("id").alias("seq"), F.col("id").cast("double").alias("ts"), F.lit("d").alias("d"))

    def took(n):
        began = time.perf_counter()
        assert folds.suppress(rows(n), ["k"], 10.0).count() == -(-n // 10)
        assert folds.chain(rows(n), ["k"], F.col("d"), "seq").filter("record_hash is not null").count() == n
        return time.perf_counter() - began

    took(1000)
    assert took(300_000) < 6 * took(100_000) + 2


def test_campaigns_equal_a_plain_loop(spark):
    r = random.Random(4)
    rows = [(i, 200.0 * i + r.random() * 100, [f"host:{r.randint(0, 12)}", f"dst:{r.randint(0, 25)}", f"port:{r.randint(0, 1)}", f"ja4:{r.randint(0, 40)}"]) for i in range(300)]
    df = spark.createDataFrame(rows, "alert_id long, ts double, pivots array<string>").repartition(5)
    got = {g.alert_id: g.campaign_id for g in correlate.join_campaigns(df, history=50, most=10, rare=math.log(9)).collect()}
    made, past, want = [], [], {}  # made: of campaigns id, pivots, last time, order of last use
    for i, ts, pivots in sorted(rows, key=lambda x: (x[1], x[0])):
        window = past[-50:]
        rare = {p for p in pivots if math.log((len(window) + 50) / (sum(p in w for w in window) + 1)) >= math.log(9)}
        fits = [c for c in made if (s := rare & c["p"]) and any(not x.startswith("port:") for x in s) and (len(s) >= 2 or abs(ts - c["t"]) <= 900)]
        if fits:
            c = max(fits, key=lambda c: (len(rare & c["p"]), -c["no"]))
            made.remove(c)
        else:
            c = {"id": correlate.campaign_id(str(i)), "p": set(), "t": ts, "no": i}
        for p in pivots:
            c["p"] |= {p} if len(c["p"]) < 64 else set()
        c["t"] = max(c["t"], ts)
        made = [*made, c][-10:]
        past.append(pivots)
        want[i] = c["id"]
    assert got == want


def test_campaigns_with_refusals_and_seeds_equal_a_plain_loop(spark):
    r = random.Random(8)
    rows, t = [], 0.0
    for i in range(2500):
        t += r.choice([0.0, 30.0, 400.0])
        pivots = [f"{k}:{r.randint(0, n)}" for k, n in (("host", 60), ("dst", 40), ("port", 3), *[("name", 150)] * r.randint(0, 6))]
        pivots[r.randint(0, len(pivots) - 1)] = None if r.random() < 0.05 else "name:x"
        refused = [p for p in pivots if p and r.random() < 0.2]
        rows.append((i, None if i < 3 else t, pivots if i % 50 else None, refused, r.choice([None, "why"]), f"seed {i if r.random() < 0.9 else r.randint(0, i)}"))
    df = spark.createDataFrame(rows, "alert_id long, ts double, pivots array<string>, refused array<string>, refused_why string, seed string").repartition(5)
    got = {g.alert_id: (g.campaign_id, g.joined_on, g.not_merged) for g in correlate.join_campaigns(df, history=200, most=40, pivots_kept=20).collect()}
    made, past, order, want = [], [], 0, {}  # made: in order of last use
    for i, ts, pivots, refused, why, seed in rows:
        pivots, best, on, notes = list(dict.fromkeys(p for p in pivots or [] if p)), None, [], []
        window = past[-200:]
        rare = {p for p in pivots if math.log((len(window) + 200) / (sum(p in w for w in window) + 1)) >= math.log(10)}
        fits = lambda s, c: any(not p.startswith("port:") for p in s) and (len(s) >= 2 or (ts is not None and c["t"] is not None and ts - c["t"] <= 900))  # noqa: B023, E731
        for c in sorted(made, key=lambda c: c["no"]):
            all_, free = rare & c["p"], (rare & c["p"]) - set(refused)
            if fits(free, c):
                if best is None or len(free) > len(on):
                    best, on = c, sorted(free)
            elif fits(all_, c) and len(notes) < 3:
                notes.append(f"{c['id']}: not merged: {why or 'common infrastructure'}")
        if best is None:
            same = [c for c in made if c["id"] == correlate.campaign_id(seed)]
            best, order = same[0] if same else {"id": correlate.campaign_id(seed), "p": set(), "no": order}, order + 1
        for p in pivots:
            best["p"] |= {p} if len(best["p"]) < 20 else set()
        best["t"] = ts
        made = [*[c for c in made if c is not best], best][-40:]
        past.append(pivots)
        want[i] = (best["id"], on, notes)
    assert got == want and any(w[2] for w in got.values())


def test_campaigns_cost_no_more_where_many_share_pivots(spark):
    import time

    r = random.Random(2)
    opening = [(23 * m + b, 0.0, [f"name:{x},{(m * x + b) % 23}" for x in range(23)]) for m in range(22) for b in range(23)]  # lines: no two share two points
    later = lambda wide: [(i, float(i), [f"name:{r.randrange(23 * wide)},{r.randrange(23)}" for _ in range(8)]) for i in range(506, 20_000)]

    def took(rows):
        df = spark.createDataFrame(rows, "alert_id long, ts double, pivots array<string>")
        began = time.perf_counter()
        assert correlate.join_campaigns(df, near=-1.0).count() == len(rows)
        return time.perf_counter() - began

    took(opening)
    assert took(opening + later(1)) < 2 * took(opening + later(100_000)) + 1


def test_sweep_counts_after_suppression(spark):
    r = random.Random(6)
    rows = [(i, r.choice("ab"), float(r.randint(0, 500)), r.randint(0, 9), r.choice([0, 1, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, k string, t double, x int, y int")
    got = {g.min_x: g for g in evaluate.sweep_deduped(df, "y", {"x": [2, 5, 8]}, ["k"], "t", "seq", 50.0).collect()}
    for bound in (2, 5, 8):
        kept = []
        for k in "ab":
            last = None
            for i, kk, t, x, y in sorted(rows, key=lambda z: (z[2], z[0])):
                if kk == k and x >= bound and (last is None or t - last >= 50):
                    last = t
                    kept.append(y)
        assert (got[bound].tp, got[bound].fp, got[bound].unknown) == (kept.count(1), kept.count(0), kept.count(None))
    ranked = evaluate.sweep_deduped(df, "y", {"x": [2, 5, 8]}, ["k"], "t", "seq", 50.0, keep_recall=0.0)
    best = ranked.orderBy("rank").collect()
    assert evaluate.pick(ranked, lambda c: c["min_x"] == best[1].min_x)["skipped"] == 1 and evaluate.pick(ranked, lambda c: False) is None


def test_data_set_and_lookups(spark):
    rows = spark.createDataFrame([(1, "k", 0.0, 1.0, 5.0), (2, "k", 50.0, 51.0, 6.0), (3, "m", 0.0, 1.0, 7.0)], "id long, key string, start double, last double, bytes double")
    labels = spark.createDataFrame([(1, "k", 0.0, 1.0, "botnet"), (2, "k", 50.0, 50.5, "background"), (3, "m", 0.0, 0.5, "normal")], "lid long, key string, s double, e double, code string")
    assert sorted(map(tuple, evaluate.labelled_rows(rows, labels, ["key"], ["bytes"]).collect())) == [(1, 5.0, 1), (3, 7.0, 0)]
    with pytest.raises(ValueError):
        evaluate.labelled_rows(rows, labels, ["key"], ["start"])
    log = spark.createDataFrame([("a", 1)], "alert_id string, ts long")
    assert alertlog.find(log, "a").count() == 1
    with pytest.raises(LookupError):
        alertlog.find(log, "b")
    old = spark.createDataFrame([(5, "x", "{\"a\":1}"), (9, "y", None)], "seq long, alert_id string, document string")
    new = alertlog.rechain(old, "seq", "document")
    state = folds.inspect_chain(new.withColumn("l", F.lit(1)), ["l"], F.col("document"), "seq").first()
    assert (state.ok, state.records) == (True, 2) and [r.seq for r in new.orderBy("seq").collect()] == [0, 1]
    assert alertlog.health(None)["alerts"] is None and alertlog.health(log)["alerts"] == 1


def test_old_alerts_are_upgraded_with_nulls(spark):
    old = spark.createDataFrame([("a", "X", 0.5)], "alert_id string, threat_class string, confidence double")
    new = alertlog.upgrade(old).first()
    assert (new.alert_id, new.schema_version, new.window_id, new.observability_state, new.campaign_id) == ("a", 2, None, None, None)
