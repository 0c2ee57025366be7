"""Ordered folds: baselines, suppression and hash chains, where each step depends on the last decision."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.operators.ordered import fold_sorted


def ewma_baseline(rows: DataFrame, key: str, bucket: str, values: list[str], alpha: float = 0.1, catch_up: int = 60) -> DataFrame:
    """rows: one per (key, bucket) with values. Returns them with, per value, mean, var and closed buckets of the smoothed
    baseline before the bucket; buckets between two rows count as 0, catch_up of them at most. The first closed bucket starts the mean.

    A run of m empty buckets has a closed form (the mean shrinks by (1 - alpha) ** m, the variance by the same and by what the shrinking adds),
    so that the fold has a step per row and no series is filled up.
    """
    keep = 1.0 - alpha

    def make() -> Callable[..., tuple]:
        at, closed, state = None, 0, [[0.0, 0.0, 0.0] for _ in values]  # of each value the last one, mean and variance

        def step(b: int, *now: float) -> tuple:
            nonlocal at, closed
            if at is not None:
                empties = min(b - at - 1, catch_up)
                for s in state:
                    last, mean, var = s
                    d = last - mean
                    m1, v1 = (last, 0.0) if closed == 0 else (mean + alpha * d, keep * (var + alpha * d * d))
                    shrink = keep**empties
                    # k-th empty bucket: var <- keep * (var + alpha * mean_k ** 2), mean_k = m1 * keep ** (k - 1)
                    s[1], s[2] = m1 * shrink, v1 * shrink + m1 * m1 * shrink * (1.0 - shrink)
                closed += 1 + empties
            at = b
            for s, v in zip(state, now):
                s[0] = v
            return (*[x for s in state for x in s[1:]], closed)

        return step

    slim = rows.select(key, F.col(bucket).cast("bigint").alias(bucket), *[F.col(v).cast("double").alias(v) for v in values])
    outputs = ", ".join([*[f"{v}_{x} double" for v in values for x in ("mean", "var")], "closed bigint"])
    return fold_sorted(slim, [key], [bucket], [bucket, *values], make, outputs)


def suppress(hits: DataFrame, keys: list[str], quiet: float, time: str = "ts", seq: str = "seq") -> DataFrame:
    """Of each key's hits in order, those at least `quiet` after the last one kept; each decision depends on the one before."""

    def make() -> Callable[..., tuple]:
        last = None

        def step(t: float) -> tuple:
            nonlocal last
            if last is None or t - last >= quiet:
                last = t
                return (True,)
            return (False,)

        return step

    return fold_sorted(hits, keys, [time, seq], [time], make, "__kept boolean").filter("__kept").drop("__kept")


GENESIS = "0" * 64


def chain(records: DataFrame, keys: list[str], document: Column, seq: str, start: str = GENESIS) -> DataFrame:
    """seq, prev_hash and record_hash: sha256 of the previous hash and the record's canonical text, per log (keys), after start."""

    def make() -> Callable[..., tuple]:
        head = start

        def step(text: str | None) -> tuple:
            nonlocal head
            before, head = head, None if text is None or head is None else hashlib.sha256((head + text).encode()).hexdigest()
            return before, head

        return step

    slim = records.select(*keys, F.col(seq).cast("bigint").alias(seq), document.cast("string").alias("__d"))
    return fold_sorted(slim, keys, [seq], ["__d"], make, "prev_hash string, record_hash string").drop("__d")


#: Why a record of a log is refused, in the order of the checks.
REASONS = ("unreadable", "sequence gap", "wrong link", "wrong hash", "confidence differs", "column differs")


def inspect_chain(log: DataFrame, keys: list[str], document: Column, seq: str, copies: dict[str, Column] | None = None, confidence: tuple[str, Column] | None = None) -> DataFrame:
    """Per log: records, ok, first_bad (its place), reason and head (the last hash; null unless ok).

    Every record is checked for itself, against the one before: its document can be read; its place is the next one; prev_hash is
    the hash before; the hash is that of the content; columns kept beside the document are equal to what it says (copies: column
    and expression over the document; confidence: the same within 1e-9). Only the hash before comes from another row.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    place = F.row_number().over(w) - 1
    link = F.coalesce(F.lag("record_hash").over(w), F.lit(GENESIS))
    differ = F.lit(False)
    for name, said in (copies or {}).items():
        differ = differ | ~F.col(name).eqNullSafe(said)
    off = F.lit(False) if confidence is None else F.col(confidence[0]).isNull() | (F.abs(F.col(confidence[0]) - F.coalesce(confidence[1], F.lit(0.0))) > 1e-9)
    tests = [document.isNull(), F.col(seq) != place, ~F.col("prev_hash").eqNullSafe(link), ~F.col("record_hash").eqNullSafe(F.sha2(F.concat("prev_hash", document), 256)), off, differ]
    reason = F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS)])
    marked = log.select(*keys, place.alias("__at"), reason.alias("__why"), "record_hash")
    first = F.min(F.when(F.col("__why").isNotNull(), F.struct("__at", "__why")))
    per = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), first.alias("__bad"), F.max_by("record_hash", "__at").alias("__head"))
    ok = F.col("__bad").isNull()
    return per.select(*keys, "records", ok.alias("ok"), F.col("__bad.__at").cast("long").alias("first_bad"), F.col("__bad.__why").alias("reason"), F.when(ok, F.col("__head")).alias("head"))


def verify_chain(log: DataFrame, keys: list[str], document: Column, seq: str) -> DataFrame:
    """Per log: records, and the first place whose hash or link is wrong (null: intact). Every record is checked for itself."""
    w = Window.partitionBy(*keys).orderBy(seq)
    link = F.coalesce(F.lag("record_hash").over(w), F.lit(GENESIS))
    bad = (F.col("prev_hash") != link) | (F.sha2(F.concat("prev_hash", document), 256) != F.col("record_hash"))
    place = F.row_number().over(w) - 1
    return log.withColumns({"__bad": F.coalesce(bad, F.lit(True)), "__at": place}).groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.min(F.when(F.col("__bad"), F.col("__at"))).cast("long").alias("first_bad"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, within: float) -> DataFrame:
    """left with value of the latest row of right at or before its time, less than `within` ago: one sort of both, no range join."""
    both = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__t": F.lit(None).cast("double"), "__k": F.lit(1)}).unionByName(
        right.select(*keys, time, F.col(value).alias("__v"), F.col(time).alias("__t"), F.lit(0).alias("__k")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(time, "__k", "__v").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("__p", F.last(F.when(F.col("__k") == 0, F.struct("__t", "__v")), ignorenulls=True).over(w)).filter("__k = 1")
    return last.withColumn(value, F.when(F.col(time) - F.col("__p.__t") < within, F.col("__p.__v"))).drop("__v", "__t", "__k", "__p")
