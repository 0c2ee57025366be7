"""Sketches as aggregates: distinct counts, count-min tables, bucketed entropy, and counts that halve with time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.operators.ordered import fold_sorted


def distinct_estimate(item: Column, log2_registers: int = 12) -> Column:
    """An aggregate: estimated number of different items."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(item, log2_registers))


def hashed(item: Column, buckets: int, row: int = 0) -> Column:
    """A bucket of an item (as text) that any engine with MD5 works out alike, another one per row."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{row}:"), item.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(buckets)


def _cells(item: str, width: int, depth: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(r).alias("row"), hashed(F.col(item), width, r).alias("cell")) for r in range(depth)])).alias("c")


def count_min(rows: DataFrame, item: str, width: int = 8192, depth: int = 4) -> DataFrame:
    """row, cell, n: the table, at most width * depth rows. Items are counted before they are spread over the rows."""
    each = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    return each.select(_cells(item, width, depth), "n").groupBy("c.row", "c.cell").agg(F.sum("n").alias("n"))


def count_min_estimate(table: DataFrame, items: DataFrame, item: str, width: int = 8192, depth: int = 4) -> DataFrame:
    """item, estimate: the least of its cells; never under the true count."""
    asked = items.select(item, _cells(item, width, depth)).select(item, "c.row", "c.cell")
    return asked.join(table, ["row", "cell"], "left").groupBy(item).agg(F.coalesce(F.min(F.coalesce("n", F.lit(0))), F.lit(0)).alias("estimate"))


def merge_count_min(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "cell").agg(F.sum("n").alias("n"))


def bucket_entropy(rows: DataFrame, by: list[str], item: str, buckets: int = 128) -> DataFrame:
    """Entropy of hash buckets: at most log2(buckets) bits, and at most the items' own entropy."""
    per = rows.groupBy(*by, hashed(F.col(item), buckets).alias("__b")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n") + 0.0).alias("entropy"))


def decayed_counts(rows: DataFrame, keys: list[str], time: str, period: float = 86400.0) -> DataFrame:
    """Per (keys, period) with rows: count so far, where what was there halves, rounded down, at each period's end."""
    per = rows.groupBy(*keys, F.floor(F.col(time) / period).cast("long").alias("period")).agg(F.count(F.lit(1)).alias("n"))

    def make() -> Callable[..., tuple]:
        at, count = None, 0

        def step(now: int, n: int) -> tuple:
            nonlocal at, count
            count = (count >> min(62, now - at) if at is not None else 0) + n
            at = now
            return (count,)

        return step

    return fold_sorted(per, keys, ["period"], ["period", "n"], make, "decayed bigint").drop("n")


def top_of_window(rows: DataFrame, key: str, weight: str, time: str, width: float, k: int = 5, tie: str = "ord") -> DataFrame:
    """The k heaviest rows of each key and window, with their rank."""
    w = F.floor(F.col(time) / width).cast("long")
    rank = F.row_number().over(Window.partitionBy(key, "w").orderBy(F.desc(weight), tie))
    return rows.withColumn("w", w).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def contributing_flows(alerts: DataFrame, flows: DataFrame, key: str, weight: str, time: str, width: float, flow: str, k: int = 5, order: str = "ord") -> DataFrame:
    """alerts (aid, key, order, time and flow, the one that set it off) with `contributing`: that flow first, then the others of its key's
    k heaviest in the window so far, equal weights in order. Alerts are few beside flows: only the flows of their windows meet them."""
    wid = F.floor(F.col(time) / width).cast("long")
    mine = alerts.select("aid", key, F.col(order).alias("__o"), F.col(flow).alias("__f"), wid.alias("__w"))
    met = mine.join(flows.select(key, wid.alias("__w"), F.col(order).alias("__fo"), F.col(weight).alias("__n"), F.col(flow).alias("__c")), [key, "__w"]).filter("__fo <= __o")
    rank = F.row_number().over(Window.partitionBy("aid").orderBy(F.desc("__n"), "__fo"))
    top = met.withColumn("__r", rank).filter(F.col("__r") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("__c") != F.col("__f"), F.struct("__r", "__c")))), lambda x: x["__c"])
    per = top.groupBy("aid").agg(listed.alias("__l"))
    return alerts.join(per, "aid", "left").withColumn("contributing", F.concat(F.array(flow), F.slice(F.coalesce("__l", F.array().cast("array<string>")), 1, k - 1))).drop("__l")


def attribute(alerts: DataFrame, attacks: DataFrame, keys: list[str], before: float = 5.0, after: float = 120.0, bucket: float = 3600.0) -> DataFrame:
    """alerts (keys, id, t) with the attack (keys, name, first, last) whose span, widened by before and after, holds t and begins
    nearest to it; null without one. Spans are spread over time buckets, so that alerts and attacks meet by an equal key."""
    spread = F.explode(F.sequence(F.floor((F.col("first") - before) / bucket).cast("long"), F.floor((F.col("last") + after) / bucket).cast("long")))
    spans = attacks.withColumn("__b", spread)
    met = alerts.withColumn("__b", F.floor(F.col("t") / bucket).cast("long")).join(spans, [*keys, "__b"]).filter((F.col("t") >= F.col("first") - before) & (F.col("t") <= F.col("last") + after))
    best = met.groupBy("id").agg(F.min_by("name", F.struct(F.abs(F.col("t") - F.col("first")), "name")).alias("attack"))
    return alerts.join(best, "id", "left")
