"""Campaigns: alerts that share rare pivots join. Pivot rarity is a window; the joining is a state machine over few alerts."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from flowloom.staging import staged

#: Number and name of the tactic that each class belongs to.
TACTICS = {
    "THREAT_RECON_PORTSCAN": ("TA0007", "Discovery"), "THREAT_C2_BEACON": ("TA0011", "Command and Control"), "THREAT_DNS_DGA": ("TA0011", "Command and Control"), "THREAT_DNS_TUNNEL": ("TA0011", "Command and Control"),
    "THREAT_ENCRYPTED_ANOMALY": ("TA0011", "Command and Control"), "THREAT_EXFILTRATION": ("TA0010", "Exfiltration"), "THREAT_DDOS_VOLUME": ("TA0040", "Impact"),
}
#: From so many sources on, a resolver is shared and one of the TOP_FAN_IN destinations is common.
SHARED, TOP_FAN_IN = 5, 10


def _looked_up(values: dict[str, str], key: str | Column, other: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.col(key) if isinstance(key, str) else key), F.lit(other))


def tactic(threat_class: str | Column) -> Column:
    return _looked_up({k: v[1] for k, v in TACTICS.items()}, threat_class, "Unclassified")


def tactic_id(threat_class: str | Column) -> Column:
    return _looked_up({k: v[0] for k, v in TACTICS.items()}, threat_class, "unclassified")


def top_fan_in(rows: DataFrame, window: float, k: int = TOP_FAN_IN, least: int = SHARED, ip: str = "ip", n: str = "n", time: str = "last_time") -> DataFrame:
    """w, ip: the k destinations with the highest fan-in (n, as of each row) of those seen in the window and the one before, with
    `least` sources at least; ties by address. A table of k rows a window, whatever the traffic."""
    wid = F.floor(F.col(time) / window).cast("long")
    per = rows.groupBy(ip, wid.alias("w")).agg(F.max(n).alias("n")).filter(F.col("n") >= least)
    spread = per.select(F.col(ip).alias("ip"), "n", F.explode(F.array(F.col("w"), F.col("w") + 1)).alias("w")).groupBy("w", "ip").agg(F.max("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("n"), "ip"))
    return spread.withColumn("r", rank).filter(F.col("r") <= k).select("w", "ip")


def refusals(flows: DataFrame, window: float) -> DataFrame:
    """flows (ord, src_ip, dst_ip, dst_port, way, last_time, dst_distinct_srcs_longterm) with dst_common and src_common: why that end is
    common infrastructure (a resolver that several ask, or one of the highest fan-ins), or null. The windows' highest fan-ins stand
    for a list that is renewed every few flows."""
    from flowloom.operators import rollups

    top = top_fan_in(flows.select(F.col("dst_ip").alias("ip"), "last_time", F.col("dst_distinct_srcs_longterm").alias("n")), window)
    tier = flows.select(F.col("dst_ip").alias("ip"), "ord", F.col("dst_distinct_srcs_longterm").alias("n"))
    at_src = rollups.probe(tier, flows.select(F.col("src_ip").alias("ip"), "ord"), ["ip"]).select("ord", F.coalesce("n", F.lit(0)).alias("src_fan_in"))
    wid = F.floor(F.col("last_time") / window).cast("long")
    mark = lambda end: top.select(F.col("w").alias("__w"), F.col("ip").alias(f"{end}_ip"), F.lit(True).alias(f"__{end}_top"))
    f = flows.withColumn("__w", wid).join(mark("dst"), ["__w", "dst_ip"], "left").join(mark("src"), ["__w", "src_ip"], "left").join(at_src, "ord", "left")

    def why(end: str, n: Column, resolver: Column) -> Column:
        common = F.concat(F.lit("high fan-in destination "), F.col(f"{end}_ip"), F.lit(" ("), n.cast("long").cast("string"), F.lit(" sources)"))
        return F.when(resolver & (n >= SHARED), F.concat(F.lit("shared resolver "), F.col(f"{end}_ip"))).when(F.coalesce(F.col(f"__{end}_top"), F.lit(False)) & (n >= SHARED), common)

    return f.withColumns({"dst_common": why("dst", F.col("dst_distinct_srcs_longterm"), F.col("dst_port") == 53), "src_common": why("src", F.coalesce("src_fan_in", F.lit(0)), F.lit(False))}).drop("__w", "__dst_top", "__src_top", "src_fan_in")


def flow_pivots(flows: DataFrame) -> DataFrame:
    """ord, host, pivots (in order: host, dst, port, fingerprints, names) and refused (those of common infrastructure: that end, and
    the port of the same server), of flows with dst_common and src_common. The host is the inside end; of two, the one that is not
    common, as of a resolver's answer."""
    from flowloom.operators.tier1 import port_class

    inside = F.col("way").isin("outbound", "internal") | (F.col("way") == "external")
    swap = (F.col("way") == "internal") & F.col("src_common").isNotNull() & F.col("dst_common").isNull()
    at_src = inside & ~swap
    host, other = F.when(at_src, F.col("src_ip")).otherwise(F.col("dst_ip")), F.when(at_src, F.col("dst_ip")).otherwise(F.col("src_ip"))
    why = F.when(at_src, F.col("dst_common")).otherwise(F.col("src_common"))
    port = F.concat(F.lit("port:"), F.col("protocol"), F.lit("/"), port_class(F.col("dst_port"), F.col("protocol")).cast("int").cast("string"))
    names = F.transform(F.concat("dns_queries", "tls_snis"), lambda n: F.concat(F.lit("name:"), F.regexp_replace(F.lower(n), r"\.+$", "")))
    shown = F.concat(F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("dst:"), other), port), F.transform("tls_ja4", lambda j: F.concat(F.lit("ja4:"), j)), names)
    refused = F.when(why.isNotNull(), F.array(F.concat(F.lit("dst:"), other), port)).otherwise(F.array().cast("array<string>"))
    return flows.select("ord", host.alias("host"), F.array_distinct(shown).alias("pivots"), refused.alias("refused"), why.alias("refused_why"))


def pivot_rarity(alerts: DataFrame, pivots: Column, seq: str = "alert_id", history: int = 1000, block: str | None = None) -> DataFrame:
    """Per alert and pivot: earlier alerts with it among the last `history` ones, and its rarity ln((n + history) / (df + 1)).

    seq counts alerts from 0 without gaps, so that the last ones are a range of it and no common sort is needed.
    """
    rows = alerts.select(seq, F.explode(F.array_distinct(pivots)).alias("pivot"))
    w = Window.partitionBy("pivot").orderBy(seq).rangeBetween(-history, -1)
    n = F.least(F.col(seq), F.lit(history))
    return rows.withColumn("df", F.count(F.lit(1)).over(w)).withColumn("rarity", F.log((n + F.lit(history)) / (F.col("df") + 1)))


def campaign_id(first_alert: str) -> str:
    return "camp-" + hashlib.sha256(first_alert.encode()).hexdigest()[:12]


def join_campaigns(alerts: DataFrame, history: int = 1000, rare: float = math.log(10), near: float = 900.0, most: int = 512, pivots_kept: int = 64) -> DataFrame:
    """alert_id, campaign_id, joined_on and not_merged of alerts (alert_id long, ts double, pivots array<string>; refused array<string>,
    refused_why and seed, if there are such columns), in order of time and id.

    An alert joins the open campaign that it shares most rare pivots with, refused ones left out: two of them, or one within `near`
    seconds of its last alert; a port never alone; ties go to the older; campaigns do not merge. A campaign keeps its alerts' pivots,
    pivots_kept at most, refused ones too: not_merged names up to 3 campaigns that only these would have joined, and why not. A
    campaign's id is of the seed (else the id) of its first alert. Of more than `most` open ones, that least lately joined closes.

    A null pivot names nothing and is left out; an alert without a time comes first and is near none.

    Each decision depends on the last, so the alerts (not flows) pass through one task, a batch at a time, with bounded state. What
    an alert costs does not grow with the open campaigns that share a pivot with it: sets of campaigns are bits of integers.
    """
    have = alerts.columns
    named = lambda c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda p: p.isNotNull())).alias(c)
    rows = alerts.select("alert_id", "ts", named("pivots"), *([named("refused")] if "refused" in have else []), *(c for c in ("refused_why", "seed") if c in have))
    outputs = "campaign_id string, joined_on array<string>, not_merged array<string>"
    schema = StructType([alerts.schema["alert_id"], *_parse_datatype_string(outputs).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _joiner(history, rare, near, most, pivots_kept)
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            whys, seeds = at.get("refused_why"), at.get("seed", at["alert_id"])
            held = _lists(at["refused"]) if "refused" in at else itertools.repeat(())
            ids, on, on_ends, notes, note_ends = [], [], [0], [], [0]
            for i, (ts, pivots, refused) in enumerate(zip(at["ts"].to_pylist(), _lists(at["pivots"]), held)):
                ids.append(step(ts, pivots, refused, whys, seeds, i, on, notes))
                on_ends.append(len(on))
                note_ends.append(len(notes))
            made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string())) for flat, ends in ((on, on_ends), (notes, note_ends))]
            yield pa.RecordBatch.from_arrays([at["alert_id"], pa.array(ids, pa.string()), *made], names=[f.name for f in schema.fields])

    return rows.repartition(1).sortWithinPartitions("ts", "alert_id").mapInArrow(run, schema)


def _lists(column: pa.ListArray) -> Iterator[list[str]]:
    ends, flat = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False).tolist()
    return (flat[a:b] for a, b in itertools.pairwise(ends))


class _Pivot:
    """held: bits of the open campaigns that keep it; df: recent alerts with it; alone: whether it may join by itself."""

    __slots__ = ("alone", "df", "held", "name")

    def __init__(self, name: str):
        self.name, self.held, self.df, self.alone = name, 0, 0, not name.startswith("port:")


class _Campaign:
    __slots__ = ("bit", "id", "last", "pivots")

    def __init__(self, id_: str):
        self.id, self.bit, self.last, self.pivots = id_, 0, math.nan, []


def _joiner(history: int, rare: float, near: float, most: int, pivots_kept: int) -> Callable[..., str]:
    """The state machine of join_campaigns(): step(ts, pivots, refused, whys, seeds, i, on, notes) returns the i-th alert's campaign
    and appends what it joined on and the notes. Alerts come in order of time, so campaigns cease to be near in order of last use."""
    known: dict[str, _Pivot] = {}
    recent: deque[list[_Pivot]] = deque()
    open_: OrderedDict[str, _Campaign] = OrderedDict()  # the least lately joined first
    fresh: OrderedDict[str, _Campaign] = OrderedDict()  # those of them that may be near, in that order
    by_bit: list[_Campaign | None] = []  # the bits are in order of making
    fresh_bits, since, common = 0, math.nan, -1  # since: no fresh one is older; common: the highest df that is rare

    def bound() -> None:
        nonlocal common
        while common < history and math.log((len(recent) + history) / (common + 2)) >= rare:
            common += 1

    def renumber() -> None:
        nonlocal fresh_bits
        by_bit[:] = sorted(open_.values(), key=lambda c: c.bit)
        for c in by_bit:
            for p in c.pivots:
                p.held = 0
        for k, c in enumerate(by_bit):
            c.bit = 1 << k
            for p in c.pivots:
                p.held |= c.bit
        fresh_bits = sum(c.bit for c in fresh.values())

    def shares(usable: list[_Pivot]) -> tuple[list[int], int]:
        """Campaigns that hold one of them, two, and so on; and those that hold one that may join alone."""
        levels, strong = [], 0
        for p in usable:
            more = p.held
            if more:
                if p.alone:
                    strong |= more
                for k, level in enumerate(levels):
                    levels[k], more = level | more, level & more
                    if not more:
                        break
                else:
                    levels.append(more)
        return levels, strong

    def joining(levels: list[int], strong: int) -> int:
        return strong & (levels[1] | fresh_bits) if len(levels) > 1 else strong & fresh_bits

    def step(ts: float | None, pivots: list[str], refused: list[str], whys: pa.Array | None, seeds: pa.Array, i: int, on: list[str], notes: list[str]) -> str:
        nonlocal fresh_bits, since
        if ts is None:
            ts = math.nan
        if not ts - since <= near:
            while fresh:
                c = next(iter(fresh.values()))
                if ts - c.last <= near:
                    since = c.last
                    break
                del fresh[c.id]
                fresh_bits ^= c.bit
        mine, usable = [], []
        for name in pivots:
            p = known.get(name)
            if p is None:
                p = known[name] = _Pivot(name)
            elif p.held and p.df <= common:
                usable.append(p)
            p.df += 1
            mine.append(p)
        every = usable
        if refused:
            usable = [p for p in every if p.name not in refused]
        levels, strong = shares(usable)
        if len(every) > len(usable):
            noted = joining(*shares(every)) & ~joining(levels, strong)
            for _ in range(3):
                if noted:
                    c = by_bit[(noted & -noted).bit_length() - 1]
                    notes.append(f"{c.id}: not merged: {(whys[i].as_py() if whys is not None else None) or 'common infrastructure'}")
                    noted &= noted - 1
        found = strong & fresh_bits
        for level in levels[:0:-1]:
            if level & strong:
                found = level & strong
                break
        if found:
            bit = found & -found
            best = by_bit[bit.bit_length() - 1]
            names = [p.name for p in usable if p.held & bit]
            on += sorted(names) if len(names) > 1 else names
            open_.move_to_end(best.id)
        else:
            best = _Campaign(campaign_id(str(seeds[i].as_py())))
            if best.id in open_:
                best = open_[best.id]
                open_.move_to_end(best.id)
            else:
                if len(by_bit) >= 2 * most + 64:
                    renumber()
                best.bit = 1 << len(by_bit)
                by_bit.append(best)
                open_[best.id] = best
            bit = best.bit
        best.last = ts
        if fresh_bits & bit:
            fresh.move_to_end(best.id)
        else:
            if not fresh:
                since = ts
            fresh[best.id] = best
            fresh_bits |= bit
        if len(best.pivots) < pivots_kept:
            for p in mine:
                if not p.held & bit and len(best.pivots) < pivots_kept:
                    p.held |= bit
                    best.pivots.append(p)
        if len(open_) > most:
            _, gone = open_.popitem(last=False)
            by_bit[gone.bit.bit_length() - 1] = None
            if fresh.pop(gone.id, None):
                fresh_bits ^= gone.bit
            for p in gone.pivots:
                p.held ^= gone.bit
                if not p.held and not p.df:
                    del known[p.name]
        recent.append(mine)
        if len(recent) > history:
            for p in recent.popleft():
                p.df -= 1
                if not p.df and not p.held:
                    del known[p.name]
        else:
            bound()
        return best.id

    bound()
    return step


def correlate(alerts: DataFrame, pivots: DataFrame) -> DataFrame:
    """alerts (of operators/alerts.py, with ord) with campaign_id, host, tactic_id, tactic, joined_on, not_merged and refused_pivots.
    pivots: of flow_pivots(), by ord."""
    met = staged(alerts.join(pivots, "ord").withColumn("seed", F.concat_ws("|", "flow_id", "timestamp", "threat_class")), "pivots")
    found = join_campaigns(met.select("alert_id", "ts", "pivots", "refused", "refused_why", "seed"))
    named = met.drop("seed", "pivots", "refused_why", "ord").withColumnRenamed("refused", "refused_pivots")
    return named.join(found, "alert_id").withColumns({"tactic_id": tactic_id("threat_class"), "tactic": tactic("threat_class")})
