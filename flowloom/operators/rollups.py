"""Running rollups as of each flow: over its window and the one before, per key, as ordered window functions.

Each row is placed in its own window and in the next one, where it counts as the past. A running aggregate over (key, window),
the past first, is then the previous window plus the current one up to the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALL = (Window.unboundedPreceding, 0)


def two_windows(rows: DataFrame, time: str, width: float) -> DataFrame:
    """Each row twice: eff, the window it counts in, and cur, 1 in its own one."""
    wid = F.floor(F.col(time) / width).cast("long")
    places = F.array(F.struct(wid.alias("eff"), F.lit(1).alias("cur")), F.struct((wid + 1).alias("eff"), F.lit(0).alias("cur")))
    return rows.withColumn("__w", F.explode(places)).withColumns({"eff": F.col("__w.eff"), "cur": F.col("__w.cur")}).drop("__w")


def running(keys: list[str], order: str = "ord") -> Window:
    return Window.partitionBy(*keys, "eff").orderBy("cur", order).rowsBetween(*ALL)


def own(rows: DataFrame) -> DataFrame:
    """The rows at their own place, once the aggregates are there."""
    return rows.filter("cur = 1").drop("cur", "eff")


def running_all(rows: DataFrame, keys: list[str], sums: dict[str, Column] | None = None, distinct: dict[str, str] | None = None, entropy: dict[str, str] | None = None, time: str = "last", width: float = 60.0, order: str = "ord") -> DataFrame:
    """Several running aggregates over one expansion and one exchange. sums: of values; distinct: the number of different items (a
    column; nulls do not count), whose first sights are marked, then added up; entropy: in bits, of the items so far: the c-th sight
    of one adds c log2 c - (c - 1) log2 (c - 1) to what log2 n is lessened by. A key's window is a task's; a key is cut by time."""
    out = two_windows(rows, time, width).repartition(*keys, "eff")  # the windows below need no other dealing
    w = running(keys, order)
    nth = lambda item: F.row_number().over(Window.partitionBy(*keys, "eff", item).orderBy("cur", order))
    marks = {}
    for name, item in (distinct or {}).items():
        marks[f"__{name}"] = ((nth(item) == 1) & F.col(item).isNotNull()).cast("long")
    for name, item in (entropy or {}).items():
        n = nth(item).cast("double")
        marks[f"__{name}"] = n * F.log2(n) - F.when(n > 1, (n - 1) * F.log2(F.greatest(n - 1, F.lit(1.0)))).otherwise(0.0)
    out = out.withColumns(marks) if marks else out
    made = {name: F.sum(value).over(w) for name, value in (sums or {}).items()} | {name: F.sum(f"__{name}").over(w) for name in distinct or ()}
    total = F.count(F.lit(1)).over(w)
    made |= {name: F.log2(total) - F.sum(f"__{name}").over(w) / total for name in entropy or ()}
    return own(out.withColumns(made).drop(*marks))


def running_sums(rows: DataFrame, keys: list[str], sums: dict[str, Column], time: str = "last", width: float = 60.0, order: str = "ord") -> DataFrame:
    return running_all(rows, keys, sums, time=time, width=width, order=order)


def running_distinct(rows: DataFrame, keys: list[str], items: dict[str, str], time: str = "last", width: float = 60.0, order: str = "ord") -> DataFrame:
    return running_all(rows, keys, distinct=items, time=time, width=width, order=order)


def running_entropy(rows: DataFrame, keys: list[str], item: str, name: str, time: str = "last", width: float = 60.0, order: str = "ord") -> DataFrame:
    return running_all(rows, keys, entropy={name: item}, time=time, width=width, order=order)


def longterm_distinct(rows: DataFrame, keys: list[str], item: str, name: str, order: str = "ord") -> DataFrame:
    first = (F.row_number().over(Window.partitionBy(*keys, item).orderBy(order)) == 1).cast("long")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(*ALL)
    return rows.withColumn("__first", first).withColumn(name, F.sum("__first").over(w)).drop("__first")


def running_count(rows: DataFrame, keys: list[str], name: str, order: str = "ord") -> DataFrame:
    """Rows of the same keys so far; null where a key is null. Rows without a key are no group, so they are dealt out by their order."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    w = Window.partitionBy(*keys, F.when(missing, F.xxhash64(F.col(order).cast("string")))).orderBy(order).rowsBetween(*ALL)
    return rows.withColumn(name, F.when(~missing, F.count(F.lit(1)).over(w)))


def periodicity(rows: DataFrame, keys: list[str], start: str = "start", order: str = "ord") -> DataFrame:
    """iat_n, iat_mean, iat_cv of the gaps between successive starts of a pair, over all its history; a start before the latest one
    makes no gap. cv: sample deviation over mean, null under two gaps or with a mean of 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.col(start) - F.max(start).over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = rows.withColumn("__gap", F.when(gap >= 0, gap))
    so_far = w.rowsBetween(*ALL)
    n, mean, sd = F.count("__gap").over(so_far), F.avg("__gap").over(so_far), F.stddev_samp("__gap").over(so_far)
    return g.withColumns({"iat_n": n, "iat_mean": mean, "iat_sd": sd}).withColumn("iat_cv", F.when((F.col("iat_n") >= 2) & (F.col("iat_mean") > 0), F.col("iat_sd") / F.col("iat_mean"))).drop("__gap", "iat_sd")


def bucket_sums(rows: DataFrame, key: str, value: str, buckets: dict[str, int], time: str = "last", width: float = 60.0, order: str = "ord") -> DataFrame:
    """For each name, the sum over the last so many buckets, the open one up to the row included."""
    b = F.floor(F.col(time) / width).cast("long")
    out = rows.withColumn("__b", b)
    inside = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(*ALL)
    out = out.withColumn("__open", F.sum(value).over(inside))
    per = rows.withColumn("__b", b).groupBy(key, "__b").agg(F.sum(value).alias("__all"))
    for name, n in buckets.items():
        before = Window.partitionBy(key).orderBy("__b").rangeBetween(-(n - 1), -1)
        per = per.withColumn(f"__{name}", F.coalesce(F.sum("__all").over(before), F.lit(0.0)) if n > 1 else F.lit(0.0))
    joined = out.join(per.drop("__all"), [key, "__b"])
    return joined.withColumns({name: F.col("__open") + F.col(f"__{name}") for name in buckets}).drop("__b", "__open", *[f"__{n}" for n in buckets])


def link_visibility(rows: DataFrame, seen: str, time: str = "last", width: float = 60.0, order: str = "ord") -> DataFrame:
    """Share of flows with both halves over the whole link: the windows' totals are added up first, so that only a window's own
    rows are sorted together."""
    wid = F.floor(F.col(time) / width).cast("long")
    tagged = rows.withColumn("__wid", wid)
    total = tagged.groupBy("__wid").agg(F.count(F.lit(1)).alias("__n"), F.count_if(seen).alias("__s")).select((F.col("__wid") + 1).alias("__wid"), "__n", "__s")
    w = Window.partitionBy("__wid").orderBy(order).rowsBetween(*ALL)
    mine = tagged.withColumns({"__cn": F.count(F.lit(1)).over(w), "__cs": F.sum(F.col(seen).cast("long")).over(w)})
    share = (F.col("__cs") + F.coalesce("__s", F.lit(0))) / (F.col("__cn") + F.coalesce("__n", F.lit(0)))
    return mine.join(total, "__wid", "left").withColumn("link_visibility", share).drop("__wid", "__n", "__s", "__cn", "__cs")


def probe(tier: DataFrame, readers: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """What a tier said last for a key as of a reader's place in the order (its own included): an as-of join by union and a window.
    tier: keys, order and value columns; readers: keys, order and columns of their own. Never seen: nulls."""
    values = [c for c in tier.columns if c not in (*keys, order)]
    held = F.struct(*values)
    mine = [c for c in readers.columns if c not in (*keys, order)]
    empty = F.lit(None).cast(f"struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in tier.select(*values).schema.fields)}>")
    both = tier.select(*keys, order, held.alias("__v"), F.lit(0).alias("__k"), *[F.lit(None).cast(readers.schema[c].dataType).alias(c) for c in mine]).unionByName(readers.select(*keys, order, empty.alias("__v"), F.lit(1).alias("__k"), *mine))
    w = Window.partitionBy(*keys).orderBy(order, "__k").rowsBetween(*ALL)
    return both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__k = 1").select(*keys, order, *mine, *[F.col(f"__v.{v}").alias(v) for v in values])
