"""Labels and evaluation: overlap joins, splits, thresholds, precision-recall, calibration, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap_join(flows: DataFrame, labels: DataFrame, keys: list[str], slack: float = 1.0, bucket: float = 86400.0) -> DataFrame:
    """flows (key columns, id, start, last) with label and state: one code among overlapping labels gives it, several make the flow
    ambiguous, none leaves it unmatched. labels: key columns, s, e, code.

    Intervals are spread over the time buckets that they touch, so that a key's long history does not meet as a whole; a pair
    that shares several buckets counts once, as codes are gathered as a set.
    """
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / bucket).cast("long"), F.floor(b / bucket).cast("long")))
    f = flows.withColumn("__b", spread(F.col("start") - slack, F.col("last") + slack))
    x = labels.select(*keys, "s", "e", "code").withColumn("__b", spread(F.col("s"), F.col("e")))
    met = f.join(x, [*keys, "__b"]).filter((F.col("s") <= F.col("last") + slack) & (F.col("e") >= F.col("start") - slack))
    codes = met.groupBy("id").agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    state = F.when(F.col("lo").isNull(), "unmatched").when(F.col("lo") == F.col("hi"), "matched").otherwise("ambiguous")
    return flows.join(codes, "id", "left").withColumns({"state": state, "label": F.when(F.col("lo") == F.col("hi"), F.col("lo"))}).drop("lo", "hi")


def coverage(labels: DataFrame, flows: DataFrame, keys: list[str], slack: float = 1.0, bucket: float = 86400.0) -> DataFrame:
    """Per code: label rows, and those that some flow overlaps."""
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / bucket).cast("long"), F.floor(b / bucket).cast("long")))
    f = flows.select(*keys, "start", "last").withColumn("__b", spread(F.col("start") - slack, F.col("last") + slack))
    x = labels.withColumn("__b", spread(F.col("s"), F.col("e")))
    hit = x.join(f, [*keys, "__b"]).filter((F.col("s") <= F.col("last") + slack) & (F.col("e") >= F.col("start") - slack)).select("lid").distinct().withColumn("hit", F.lit(1))
    return labels.join(hit, "lid", "left").groupBy("code").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("matched"))


def time_split(rows: DataFrame, group: str, start: str, tie: str, share: float = 0.7) -> DataFrame:
    """With fold: train for each group's first floor(share * n) rows by start, else test."""
    w = Window.partitionBy(group)
    place = F.row_number().over(w.orderBy(start, tie))
    return rows.withColumn("fold", F.when(place <= F.floor(F.count(F.lit(1)).over(w) * share), "train").otherwise("test"))


def group_folds(rows: DataFrame, group: str, y: str) -> DataFrame:
    """Leave one group out: per group its rows and positives, and those of all others."""
    per = rows.groupBy(group).agg(F.count(F.lit(1)).alias("test_n"), F.sum(y).cast("long").alias("test_pos"))
    total = per.agg(F.sum("test_n").alias("n"), F.sum("test_pos").alias("pos"))
    return per.crossJoin(F.broadcast(total)).select(group, "test_n", "test_pos", (F.col("n") - F.col("test_n")).alias("train_n"), (F.col("pos") - F.col("test_pos")).alias("train_pos"))


def budget_threshold(rows: DataFrame, group: str, y: str, score: str, rate: float, least: float = 0.0) -> DataFrame:
    """Per group, the score of the benign row that floor(rate * n) benign rows are ranked above. Where rate * n is under `least`, there
    are too few rows to tell the rate, and it widens to least / n; of fewer rows than that, it is the lowest score."""
    w = Window.partitionBy(group)
    ranked = rows.filter(F.col(y) == 0).select(group, score, F.row_number().over(w.orderBy(F.desc(score))).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    wide = F.when(F.col("n") * rate < least, F.lit(least) / F.col("n")).otherwise(F.lit(rate))
    allowed = F.least(F.floor(F.col("n") * wide + 1e-9), F.col("n") - 1)
    return ranked.filter(F.col("r") == allowed + 1).select(group, F.col(score).alias("threshold"))


def at_threshold(y: str, hit: Column) -> list[Column]:
    """Aggregates: counts, precision, recall, false positives per 10,000 benign rows; null where undefined."""
    pos, neg = F.col(y) == 1, F.col(y) == 0
    tp, fp, fn = F.count_if(pos & hit), F.count_if(neg & hit), F.count_if(pos & ~hit)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"), F.round(F.try_divide(fp * 10000.0, F.count_if(neg)), 6).alias("fp_per_10k")]


def average_precision(rows: DataFrame, group: str, y: str, score: str) -> DataFrame:
    """Per group, the step sum of precision over recall; equal scores are one point."""
    per = rows.groupBy(group, score).agg(F.sum(y).cast("long").alias("p"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    cum = per.withColumns({"cp": F.sum("p").over(w), "cn": F.sum("n").over(w)})
    return cum.groupBy(group).agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("cp") / F.col("cn")), F.sum("p")), 6).alias("average_precision"))


def calibration(rows: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Per score bin (the last closed): rows, mean score, share of positives, and squared error."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(F.col(y).cast("double")), 6).alias("share"), F.round(F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))), 6).alias("brier"))


def sweep(rows: DataFrame, y: str, bounds: dict[str, list[float]], keep_recall: float = 0.9) -> DataFrame:
    """Every combination of lower bounds, on rows where a bound's column has to be at least it (null never passes): counts, and the
    rank among those that keep the recall, by fewest hits, then precision, then the bounds. The grid is a handful of literals."""
    grid = F.array(F.struct(*[F.lit(0.0).alias(c) for c in bounds]))
    combos = [[]]
    for c, values in bounds.items():
        combos = [[*x, F.lit(float(v)).alias(c)] for x in combos for v in values]
    grid = F.explode(F.array(*[F.struct(*x) for x in combos])).alias("g")
    # rows with equal values and label count together, so that what is multiplied by the grid is their distinct combinations
    small = rows.groupBy(*bounds, y).agg(F.count(F.lit(1)).alias("n"))
    hit = None
    for c in bounds:
        one = F.coalesce(F.col(c) >= F.col(f"g.{c}"), F.lit(False))
        hit = one if hit is None else hit & one
    pos = F.col(y) == 1
    by = [F.col(f"g.{c}").alias(f"min_{c}") for c in bounds]
    total = small.select("*", grid).withColumn("hit", hit).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(pos & F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(~pos & F.col("hit"), F.col("n"))), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.when(pos, F.col("n"))), F.lit(0)).alias("pos")
    )
    ok = total.withColumn("keeps", F.col("tp") >= F.col("pos") * keep_recall)
    order = Window.orderBy(F.desc("keeps"), F.col("tp") + F.col("fp"), F.desc(F.try_divide("tp", F.col("tp") + F.col("fp"))), *[f"min_{c}" for c in bounds])
    return ok.withColumn("rank", F.row_number().over(order)).drop("pos")


def digest(rows: DataFrame, document: Column, by: list[str], prefix: int = 3) -> DataFrame:
    """A digest of each group's records that does not depend on their order: the sorted sha256 of those that share the first `prefix`
    digits are digested, and then these digests in order. No group is gathered as a whole."""
    each = rows.select(*by, F.sha2(document, 256).alias("__h"))
    some = each.groupBy(*by, F.substring("__h", 1, prefix).alias("__p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__h")), ""), 256).alias("__d"), F.count(F.lit(1)).alias("__n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__p", "__d"))), lambda x: x["__d"])
    return some.groupBy(*by).agg(F.sha2(F.array_join(listed, ""), 256).alias("digest"), F.sum("__n").cast("long").alias("n"))


def label_code(label: str | Column) -> Column:
    """The code of a labelled list's text, by how it begins."""
    c = F.col(label) if isinstance(label, str) else label
    out = None
    #: Beginnings of labels and the code each stands for.
    for begins, code in {"flow=From-Botnet": "botnet", "flow=From-Normal": "normal", "flow=To-Botnet": "to-botnet", "flow=To-Normal": "to-normal"}.items():
        out = F.when(c.startswith(begins), code) if out is None else out.when(c.startswith(begins), code)
    return out.otherwise("background")


def train_label(code: str | Column) -> Column:
    """1: an attacker's flow, 0: a normal one; null: neither, not to be learned from."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c == "botnet", 1).when(c == "normal", 0)


def constructed_label(src: str, dst: str, endpoint: str, threat_class: str) -> Column:
    """Label and class of a flow of a made scene: those that touch the attack's endpoint are malicious."""
    hit = (F.col(src) == F.lit(endpoint)) | (F.col(dst) == F.lit(endpoint))
    return F.struct(hit.cast("int").alias("y"), F.when(hit, threat_class).otherwise("benign-baseline").alias("class"))


def labelled_rows(rows: DataFrame, labels: DataFrame, keys: list[str], keep: list[str], slack: float = 1.0) -> DataFrame:
    """A data set to learn from: the rows (keys, id, start, last, and the columns of keep) that exactly one code overlaps, and one that
    is learned from, with y. Columns that name a host, flow or time may not be kept."""
    from flowloom.operators.ml import refuse_identity

    refuse_identity(keep)
    told = overlap_join(rows.select(*keys, "id", "start", "last"), labels, keys, slack).filter("state = 'matched'").select("id", train_label("label").alias("y"))
    return rows.select("id", *keep).join(told.filter("y is not null"), "id")


def alert_outcomes(alerts: DataFrame, flows: DataFrame, infected: DataFrame, normal: DataFrame, slack: float = 1.0) -> DataFrame:
    """alerts (alert_id, trigger, start, by_rule, first, second: the hosts that a rule's alert may be about, in order, or nulls) with
    outcome (tp, fp, unknown) and via (flow, entity, -).

    A label of the flow that set an alert off (flows: flow_id, start, code), starting within `slack`, decides first; then, of rules'
    alerts, if a host is infected, or normal (tables of ip); else it is unknown. Several such flows: the one that starts first.
    """
    met = alerts.select("alert_id", F.col("trigger").alias("flow_id"), F.col("start").alias("__t")).join(flows.filter("code in ('botnet', 'normal')"), "flow_id").filter(F.abs(F.col("start") - F.col("__t")) <= slack)
    by_flow = met.groupBy("alert_id").agg(F.min_by("code", F.struct("start", "code")).alias("__code"))
    out = alerts.join(by_flow, "alert_id", "left")
    for end in ("first", "second"):
        for name, ips in (("bad", infected), ("good", normal)):
            out = out.join(ips.select(F.col("ip").alias(end), F.lit(True).alias(f"__{end}_{name}")).distinct(), end, "left")
    some = lambda name: F.col("by_rule") & (F.coalesce(F.col(f"__first_{name}"), F.lit(False)) | F.coalesce(F.col(f"__second_{name}"), F.lit(False)))
    outcome = F.when(F.col("__code") == "botnet", "tp").when(F.col("__code") == "normal", "fp").when(some("bad"), "tp").when(some("good"), "fp").otherwise("unknown")
    via = F.when(F.col("__code").isNotNull(), "flow").when(some("bad") | some("good"), "entity").otherwise("-")
    return out.select(*alerts.columns, outcome.alias("outcome"), via.alias("via"))


def entities(threat_class: str, src: str, dst: str) -> Column:
    """The hosts an alert may be about, in order: of a flood the victim first, of others the source; of outflows none."""
    c = F.col(threat_class)
    of = lambda a, b: F.struct(F.col(a).alias("first"), F.col(b).alias("second"))
    none = F.struct(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("second"))
    return F.when(c == "THREAT_DDOS_VOLUME", of(dst, src)).when(c.isin("THREAT_C2_BEACON", "THREAT_ENCRYPTED_ANOMALY", "THREAT_RECON_PORTSCAN", "THREAT_DNS_DGA", "THREAT_DNS_TUNNEL"), of(src, dst)).otherwise(none)


def precision_known(outcomes: DataFrame, by: str, flows: int) -> DataFrame:
    """Per detector: alerts, outcomes, precision over those that are known (null without any), share of unknown ones, alerts per
    10,000 flows."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    at = lambda o, v: F.count_if((F.col("outcome") == o) & (F.col("via") == v)).alias(f"{o}_{v}")
    return outcomes.groupBy(by).agg(
        F.count(F.lit(1)).alias("alerts"), n("tp").alias("tp"), n("fp").alias("fp"), n("unknown").alias("unknown"), at("tp", "flow"), at("tp", "entity"), at("fp", "flow"), at("fp", "entity"),
        F.round(F.try_divide(n("tp"), n("tp") + n("fp")), 4).alias("precision_known"), F.round(n("unknown") / F.count(F.lit(1)), 4).alias("unknown_share"), F.round(F.try_divide(F.count(F.lit(1)) * 10000.0, F.lit(flows)), 2).alias("per_10k_flows"),
    )


def sweep_deduped(rows: DataFrame, y: str, bounds: dict[str, list[float]], keys: list[str], time: str, seq: str, quiet: float, keep_recall: float = 0.9) -> DataFrame:
    """sweep() over what is left of each combination's hits after suppression (per keys, `quiet` after the last kept). Only rows that
    some combination hits are taken times the combinations that they pass, and each combination is suppressed for itself."""
    from flowloom.operators.folds import suppress

    combos: list[dict[str, float]] = [{}]
    for c, values in bounds.items():
        combos = [{**x, c: float(v)} for x in combos for v in values]
    passed = [F.when(_all([F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in x.items()]), F.struct(F.lit(i).alias("combo"), *[F.lit(v).alias(f"min_{c}") for c, v in x.items()])) for i, x in enumerate(combos)]
    names = [f"min_{c}" for c in bounds]
    hits = rows.select(*keys, time, seq, y, F.explode(F.array_compact(F.array(*passed))).alias("g")).select(*keys, time, seq, y, "g.*")
    kept = suppress(hits, ["combo", *keys], quiet, time, seq)
    per = kept.groupBy("combo", *names).agg(F.count_if(F.col(y) == 1).alias("tp"), F.count_if(F.col(y) == 0).alias("fp"), F.count_if(F.col(y).isNull()).alias("unknown"))
    best = per.agg(F.max("tp").alias("most"))
    ok = per.crossJoin(F.broadcast(best)).withColumn("keeps", F.col("tp") >= F.col("most") * keep_recall)
    hits_ = F.col("tp") + F.col("fp") + F.col("unknown")
    order = Window.orderBy(F.desc("keeps"), hits_, F.desc(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))), *names)
    return ok.withColumn("rank", F.row_number().over(order)).drop("most", "combo")


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def pick(ranked: DataFrame, holds, most: int = 100) -> dict | None:
    """The first combination by rank that `holds` (a function of its row as a dict, such as a run of regression checks), with how many
    it was tried before; None if none of the first `most` does."""
    for i, row in enumerate(ranked.filter("keeps").orderBy("rank").limit(most).collect()):
        if holds(row.asDict()):
            return {**row.asDict(), "skipped": i}
    return None


def one_way_table(packets: DataFrame, detect) -> DataFrame:
    """threat_class and how many alerts detect gives on all packets, on those that come in and on those that go out."""
    from flowloom.sources.pcap import one_way

    ways = {"both": packets, "inward": one_way(packets, "IN"), "outward": one_way(packets, "OUT")}
    rows = None
    for name, p in ways.items():
        got = detect(p).select("threat_class", F.lit(name).alias("way"))
        rows = got if rows is None else rows.unionByName(got)
    return rows.groupBy("threat_class").agg(*[F.count_if(F.col("way") == name).alias(name) for name in ways])


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not the other, copies counted: side and the row."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
