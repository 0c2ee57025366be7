"""Exact top-k by inner product: a pivot-distance index, annuli around pivots, and triangle-inequality bounds.

With one more coordinate that makes all vectors as long as the longest one, the largest inner product is the least distance to
the query. Vectors are keyed by their nearest pivot and the annulus of their distance to it, and lie by that distance. A query
takes annuli in the order of their bounds, in rounds; its k-th score so far stops it before those that cannot beat it, and within
an annulus leaves out the distances from which no vector can.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import forget, release, small_batches, stage, table

#: Doubles hold products and sums exactly up to here.
_EXACT = float(1 << 53)


class Pivots:
    """points: pivots with the further coordinate; norm: squared length of the longest vector; edges: of the annuli, by pivot."""

    def __init__(self, sample: np.ndarray, norm: float, n_pivots: int, rings: int):
        self.norm = norm
        lifted = self.lift(sample)
        chosen = [int(np.argmax((lifted**2).sum(axis=1)))] if len(lifted) else []
        far = np.full(len(lifted), np.inf)
        while chosen and len(chosen) < min(n_pivots, len(lifted)):  # each next one is the farthest from those before
            far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.points = lifted[chosen]
        self.edges = np.zeros((len(chosen), rings - 1))
        if chosen:
            near, dist = self.nearest(lifted)
            for p in range(len(chosen)):
                own = dist[near == p]
                self.edges[p] = np.quantile(own, np.arange(1, rings) / rings) if len(own) else 0.0

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm - (vectors.astype(float) ** 2).sum(axis=1)))
        return np.hstack([vectors.astype(float), rest[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        d = (lifted**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1) - 2 * lifted @ self.points.T
        return np.sqrt(np.maximum(0.0, d))

    def nearest(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(lifted)
        near = d.argmin(axis=1)
        return near, d[np.arange(len(d)), near]

    def ring(self, near: np.ndarray, dist: np.ndarray) -> np.ndarray:
        return (dist[:, None] > self.edges[near]).sum(axis=1)


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, each component's floor(scale * x); vectors that are null or hold a null or non-finite component go."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A row per vector; short ones are filled up with zeros, which change no inner product."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = (np.abs(a).max(initial=0)).astype(float) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if top < _EXACT else a @ b.T


def _search(rows: DataFrame, dim: int, k: int, reach: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], scored: Accumulator | None) -> DataFrame:
    """rows: block, part, is_query, dist (to the block's pivot), id, v, least (of a query: no score below counts). Within each (block,
    part), whose vectors come before its queries and lie by distance, each query's k best: query_id, vec_id, score. Queries pass as
    a stream, in tiles of like distance; a tile is multiplied with the vectors within reach of one of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        at, held, ready, pairs = None, [], None, 0
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            got: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key, is_query = tuple(keys[a, :2].tolist()), keys[a, 2]
                if key != at:
                    at, held, ready = key, [], None
                part = batch.slice(a, b - a)
                own = (part.column(3).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(5), dim))
                if not is_query:
                    held.append(own)
                    continue
                if ready is None:
                    ready = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0), np.zeros(0, np.int64), np.zeros((0, dim), np.int64)]
                dist, ids, vectors = ready
                least = part.column(6).to_numpy()
                nearest, farthest = reach(own, least)
                first, last = np.searchsorted(dist, nearest, "left"), np.searchsorted(dist, farthest, "right")
                for c in range(0, len(own[1]), 256):
                    lo, hi = int(first[c : c + 256].min()), int(last[c : c + 256].max())
                    if lo >= hi:
                        continue
                    score = _products(own[2][c : c + 256], vectors[lo:hi])
                    pairs += score.size
                    fit = (score >= least[c : c + 256, None]) & (ids[lo:hi] != own[1][c : c + 256, None])
                    for i in np.flatnonzero(fit.any(axis=1)):
                        there = np.flatnonzero(fit[i])
                        if len(there) > k:
                            there = there[np.lexsort((ids[lo + there], -score[i, there]))[:k]]
                        got[0].append(np.full(len(there), own[1][c + i]))
                        got[1].append(ids[lo + there])
                        got[2].append(score[i, there])
            if got[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in got], names=["query_id", "vec_id", "score"])
        if scored is not None:
            scored.add(pairs)

    dealt = rows.repartition("block", "part").sortWithinPartitions("block", "part", "is_query", "dist", "id")
    return dealt.select("block", "part", "is_query", "dist", "id", "v", "least").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, n_pivots: int = 64, most_blocks: int = 4096, sample_rows: int = 20_000, block_rows: int = 4096, seed: int = 1, scored: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among all vectors of another id; ties to smaller ids.

    vectors and queries: vec_id and v (integers), as quantise() gives them; other columns are left out. Repeated vectors count as
    rows of their own, a query given twice is answered once, by the best of its vectors. Fewer than k others: all. No vectors or no
    queries: none. sample_rows: rows that pivots and annuli are fitted on, the ones with the least hashes; every vector is indexed.
    block_rows: vectors of an annulus, on average, until there are most_blocks of them; beyond, an annulus is cut into parts.
    A query takes its annuli in the order of their bounds: the best one, then 4 more, 16 more and so on, and after each round those
    go whose bound is under its k-th score so far. scored: gets the number of products that were worked out.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    held = stage(vectors.select("vec_id", "v"), "topk-vectors")
    facts = held.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm"), F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    dim, wanted = int(facts.dim or 0), min(most_blocks, -(-facts.n // block_rows))
    few = held.select("v").orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(sample_rows)
    sample = [r.v for r in few.collect()]
    matrix = np.zeros((len(sample), dim), np.int64)
    for i, v in enumerate(sample):
        matrix[i, : len(v)] = v
    n_pivots = max(1, min(n_pivots, wanted))
    index = Pivots(matrix, float(facts.norm or 0.0), n_pivots, max(1, -(-wanted // n_pivots)))
    slack = 1e-6 * (1.0 + index.norm)

    def keyed(df: DataFrame) -> DataFrame:
        """With pivot and ring, and dist, the distance to the pivot."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near, dist = index.nearest(index.lift(_matrix(batch.column(1), dim))) if len(index.points) and len(batch) else (np.zeros(0, np.int64), np.zeros(0))
                ring = index.ring(near, dist) if len(near) else near
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(dist)], names=["id", "v", "pivot", "ring", "dist"])

        return df.select(F.col("vec_id").cast("long"), "v").mapInArrow(run, "id long, v array<long>, pivot int, ring int, dist double")

    placed = stage(keyed(held), "topk-placed")
    release(held)
    # at most n_pivots more than most_blocks rows
    annuli = placed.groupBy("pivot", "ring").agg(F.min("dist").alias("inner"), F.max("dist").alias("outer"), F.count(F.lit(1)).alias("n")).orderBy("pivot", "ring").withColumn("parts", F.ceil(F.col("n") / (4 * block_rows)).cast("int")).collect()
    if not annuli:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivot, ring, parts = (np.array([r[x] for r in annuli]) for x in ("pivot", "ring", "parts"))
    inner, outer = (np.array([r[x] for r in annuli]) for x in ("inner", "outer"))
    table_ = spark.createDataFrame([(r.pivot, r.ring, i, r.parts) for i, r in enumerate(annuli)], "pivot int, ring int, block int, parts int")
    blocks = placed.join(F.broadcast(table_), ["pivot", "ring"]).select("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("is_query"), "dist", "id", "v", F.lit(0).cast("long").alias("least"))

    def lifted(m: np.ndarray) -> np.ndarray:
        """A query has its own squared length; in the lifted space its further coordinate is 0."""
        return np.hstack([m.astype(float), np.zeros((len(m), 1))])

    def reach(own: tuple[np.ndarray, ...], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivot between which a vector has to lie to score `least`: |query - vector| bounds the score."""
        dist, _, m = own
        room = (m.astype(float) ** 2).sum(axis=1) + index.norm + 2 * slack - 2 * least.astype(float)
        apart = np.sqrt(np.maximum(0.0, room)) + 1e-6 * (1 + dist)
        return np.where(room < 0, 1.0, dist - apart), np.where(room < 0, 0.0, dist + apart)

    def routed(df: DataFrame, begin: int, end: int) -> DataFrame:
        """A row per query and annulus from the begin-th to before the end-th by bound, where the bound can still beat `least`."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                rows = lifted(_matrix(batch.column(1), dim))
                d = index.distances(rows)[:, pivot]
                apart = np.maximum(0.0, np.maximum(inner - d, d - outer))
                best = ((rows**2).sum(axis=1)[:, None] + index.norm - np.maximum(0.0, apart - 1e-7 * (1 + d)) ** 2) / 2 + slack
                order = np.argsort(-best, axis=1, kind="stable")[:, begin:end]
                q, c = np.nonzero(np.take_along_axis(best, order, axis=1) >= batch.column(2).to_numpy()[:, None].astype(float))
                a = order[q, c]
                cols = [batch.column(i).take(pa.array(q)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(a.astype(np.int32)), pa.array(d[q, a]), pa.array(parts[a].astype(np.int32))], names=["id", "v", "least", "block", "dist", "parts"])

        went = df.select("id", "v", "least").mapInArrow(run, "id long, v array<long>, least long, block int, dist double, parts int")
        return went.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("is_query"), "dist", "id", "v", "least")

    asked = stage(queries.select(F.col("vec_id").cast("long").alias("id"), "v").distinct(), "topk-queries")
    # with a query's vectors of one id apart, its k-th score is no bound for each of them
    repeated = asked.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    open_ = asked.join(repeated, "id").select("id", "v", "times", F.lit(-(1 << 62)).cast("long").alias("least"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best: DataFrame | None = None
    begin, step = 0, 1
    while begin < len(annuli):
        found = _search(blocks.unionByName(routed(open_, begin, begin + step)), dim, k, reach, scored)
        found = found if best is None else found.unionByName(best)
        begin, step = begin + step, step * 4
        now = stage(found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k), "topk-best")
        if best is not None:
            release(best._kept)
        best = now.drop("rank")
        best._kept = now
        if begin < len(annuli):
            kth = now.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
            known = F.when(F.col("times") == 1, F.col("kth"))
            open_ = asked.join(repeated, "id").join(kth, "id", "left").select("id", "v", "times", F.coalesce(known, F.lit(-(1 << 62))).cast("long").alias("least"))
    return best._kept.select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP6_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q, e c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
