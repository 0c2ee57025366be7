"""Mixing sources to target weights, in DataFrame operations only.

Sizes are added up per source, targets follow from the weights, and each document is emitted floor(rate) times plus one
more time with the fraction as probability, decided by a seeded hash of its id and size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import free_prefix, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources, their table is broadcast; beyond, the join shuffles it.
BROADCAST_SOURCES = 10_000


def n_words(text: str = "text") -> F.Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """Per source (null is one): source_size and target.

    Sources by code point, null last, take `weights` in turn. The targets add up to share[0]/share[1] of all sizes; none is
    above `most` times its source's size, and what is cut is shared by weight among the others until none is above. With
    the caps ordered by cap/weight, the capped sources are a prefix, so that one running sum finds the common level.
    The sums are integers, and one division and one product follow, so that any engine gets the same doubles.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    one = Window.partitionBy(F.lit(1))
    ranked = per.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    by_cap = one.orderBy((F.col("cap") / F.col("w")).asc(), F.col("rank").asc())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("w", w)
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("budget", F.lit(share[0]) * F.sum("source_size").over(one))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("w_all", F.sum("w").over(one))
        .withColumn("level", (F.col("budget") - F.lit(share[1]) * F.col("cap_before")).cast("double") / (F.lit(share[1]) * (F.col("w_all") - F.col("w_before"))).cast("double"))
        .withColumn("open", F.col("cap").cast("double") > F.col("level") * F.col("w"))
        .withColumn("common", F.max(F.when(F.col("open"), F.col("level"))).over(one))
    )
    return level.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("common") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def uniform(seed: int, *cols: str) -> F.Column:
    """A number in [0, 1) that the seed and the columns (nulls: empty) decide."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long").cast("double") / F.lit(float(2**32))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 17, size: str | None = None) -> DataFrame:
    """The documents with size, source_size, target and copies, how often the mix takes each, under names that begin with the
    underscores that no column of docs begins with (free_prefix()).

    docs has doc_id, source, and text, or their sizes in a column named by `size`; other columns stay, whatever their names. Null
    text: size 0. Null source: a source of its own, ranked last. Repeated rows draw alike, as the draw depends on the id and size. A
    source without words has target 0. An empty table gives an empty result. Copies of a document: floor(target / source size), plus
    one if its draw is under the fraction.
    """
    p = free_prefix(docs.columns)
    sized = docs.withColumn(f"{p}size", n_words() if size is None else F.col(size))
    rates = stage(source_targets(sized.select("source", F.col(f"{p}size").alias("size")), weights, share, most), "mix-rates")
    n = rates.count()
    rates = rates.select(F.col("source").alias(f"{p}source"), F.col("source_size").alias(f"{p}source_size"), F.col("target").alias(f"{p}target"))
    if n <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    per = F.when(F.col(f"{p}source_size") > 0, F.col(f"{p}target") / F.col(f"{p}source_size")).otherwise(F.lit(0.0))
    rate = F.col(f"{p}rate")
    return (
        sized.join(rates, F.col("source").eqNullSafe(F.col(f"{p}source")))
        .withColumn(f"{p}rate", F.least(per, F.lit(float(most))))
        .withColumn(f"{p}copies", (F.floor(rate) + (uniform(seed, "doc_id", f"{p}size") < rate - F.floor(rate)).cast("long")).cast("long"))
        .drop(f"{p}source", f"{p}rate")
    )


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as the mix takes it. columns: those of mix()'s docs."""
    copies = f"{free_prefix(columns)}copies"
    each = mixed.filter(F.col(copies) > 0)
    return each.select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copies)).drop(copies)


def op4_mixing(spark, sf_dir):
    from flowloom.llm.common import table

    # the texts are read once: what the targets and the draws need of them is their size
    sized = stage(table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("words")), "mix-sizes")
    mixed = mix(sized, size="words")
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, 2 * source_size AS cap FROM r),
c AS (SELECT *, 3 * sum(source_size) OVER () AS budget,
  coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before, sum(w) OVER () AS w_all FROM w),
l AS (SELECT *, (budget - 2 * cap_before)::DOUBLE / (2 * (w_all - w_before))::DOUBLE AS level FROM c),
m AS (SELECT *, max(CASE WHEN cap::DOUBLE > level * w THEN level END) OVER () AS common FROM l),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(common * w, cap::DOUBLE)) AS target FROM m),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END, 2.0) AS rate,
  ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
