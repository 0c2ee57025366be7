"""SimHash near-duplicates: tiled exact comparison of fingerprints with numpy, by exclusive or and bit counts.

Fingerprints within the radius agree on some of their blocks of bits, so that tiles are made within such a block's value and
no pair is lost. Tile pairs whose population counts differ beyond the radius are skipped. Tiles hand on spanning links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import free_prefix, map_rows, release, stage, table
from flowloom.llm.graph import connected_components

PIECE = 1 << 20


def space_pieces(text: bytes) -> Iterator[list[bytes]]:
    r"""The words [^\x20\x09-\x0D]+ of a whole text, some at a time."""
    at, end = 0, len(text)
    while at < end:
        cut = min(end, at + PIECE)
        while cut < end and text[cut - 1] not in b" \t\n\v\f\r":
            near = text.rfind(b" ", at, cut)
            cut = near + 1 if near >= at else min((x for x in (text.find(s, cut) for s in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if x >= 0), default=end - 1) + 1
        yield text[at:cut].split()
        at = cut


def fingerprint(text: bytes, width: int = 4) -> int:
    """64 bits: each is 1 if set in over half of the shingles' hashes. Fewer words than width: one shingle of all. None: 0."""
    ones, n, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_digest

    def count(hashes: list[bytes]) -> None:
        rows = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
        for i in range(0, len(rows), 32768):
            ones.__iadd__(np.add.reduce(np.unpackbits(rows[i : i + 32768], axis=1), axis=0, dtype=np.uint16))

    for words in space_pieces(text.lower()):
        words = carry + words
        carry = words[-(width - 1) :]
        if len(words) >= width:
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(sizes)
            line = b" ".join(words)
            hashes = [digest(line[a:b], 42) for a, b in zip((ends - sizes).tolist(), (ends - 1)[width - 1 :].tolist())]
            n += len(hashes)
            count(hashes)
    if not n and carry:
        n = 1
        count([digest(b" ".join(carry), 42)])
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and fp, the fingerprint as a signed long. Null text: as an empty one, fingerprint 0."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        return {k: cols[k] for k in keep} | {"fp": [fp - (1 << 64) if (fp := fingerprint(t or b"")) >> 63 else fp for t in cols["text"]]}

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return map_rows(docs.select(*keep, "text"), rows, f"{kinds}, fp long", binary=("text",))


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks, as signed longs, of any blocks - radius of the blocks: two fingerprints within the radius agree under one at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(each, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def tile_links(fps: np.ndarray, side: np.ndarray, radius: int, tile: int = 512) -> list[tuple[int, int]]:
    """Spanning links (row, row) of the pairs within the radius; between sides if there are two, else among all rows."""
    n, cross = len(fps), side.min() != side.max()
    pops = np.bitwise_count(fps)
    order = np.lexsort((pops,))
    fps, pops, side = fps[order], pops[order].astype(np.int16), side[order]
    root = np.arange(n)
    for a in range(0, n, tile):
        for b in range(a, n, tile):
            if pops[b] - pops[min(a + tile, n) - 1] > radius:
                break
            near = np.bitwise_count(fps[a : a + tile, None] ^ fps[None, b : b + tile]) <= radius
            if cross:
                near &= side[a : a + tile, None] != side[None, b : b + tile]
            if a == b:
                near = np.triu(near, 1)
            for i in np.flatnonzero(near.any(axis=1)):
                met = np.unique(np.append(root[b + np.flatnonzero(near[i])], root[a + i]))
                if len(met) > 1:
                    root[np.isin(root, met[1:])] = met[0]
    return [(int(order[i]), int(order[root[i]])) for i in np.flatnonzero(root != np.arange(n))]


def links(distinct: DataFrame, radius: int, n: int, tile_rows: int = 8192) -> DataFrame:
    """u, v: spanning links of the fingerprints (column fp, each once) within the radius; of an empty or single one, none.

    The number of blocks follows from the count n so that a block's value has few thousand rows on average. Values with more
    than tile_rows are cut into parts, and each pair of parts is a task's group of its own.
    """
    blocks = next((b for b in range(radius + 1, radius + 5) if n >> (64 * (b - radius) // b) <= 4096), radius + 5)
    masks = block_masks(blocks, radius)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks)])).alias("b")).select("fp", "b.c", "b.k")
    sizes = keyed.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / tile_rows).cast("int")
    dealt = (
        keyed.join(sizes, ["c", "k"])
        .withColumn("g", parts)
        .withColumn("s", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("c", "k", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "s", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            cols = [t.column(i).to_numpy() for i in range(6)]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])
            starts = np.append(np.flatnonzero(new), t.num_rows)
            u, v = [], []
            for a, b in zip(starts[:-1], starts[1:] if last else starts[1:-1]):
                if b - a > 1:
                    fps = cols[5][a:b]
                    for x, y in tile_links(fps.view(np.uint64), cols[4][a:b], radius):
                        u.append(fps[x])
                        v.append(fps[y])
            out = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            return out, None if last else t.slice(starts[-2])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if t.num_rows:
                out, rest = groups(t, False)
                yield out
        if rest is not None and rest.num_rows:
            yield groups(rest, True)[0]

    return dealt.repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j").mapInArrow(run, "u long, v long")


def components(rows: DataFrame, radius: int = 4) -> DataFrame:
    """fp, root: for each fingerprint of rows (column fp) the least fingerprint that it reaches over links, itself included."""
    distinct = stage(rows.select("fp").distinct(), "simhash-distinct")
    found = connected_components(links(distinct, radius, distinct.count()))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id: the smallest doc_id of the documents reachable over fingerprints within the radius.

    docs has doc_id and text; other columns are left out. Null or empty text: fingerprint zero, linked like any other. Null
    doc_id: a member, never the smallest unless all are null. Repeated rows stay. An empty table gives none.
    """
    rows = stage(fingerprints(docs), "simhash-rows")
    roots = components(rows, radius)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    members = stage(least.join(roots, "fp"), "simhash-members")
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The row of each component with the smallest doc_id (nulls last; of several such rows, that of the least text digest; of equal
    rows, one), with the columns of docs, whatever others there are. An empty table gives none."""
    p = free_prefix(docs.columns)
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    names = (f"{p}id", f"{p}key")
    tagged = docs.withColumns(dict(zip(names, (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key))))
    rows = stage(fingerprints(tagged, ("doc_id", *names)), "simhash-rows")
    each = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", names[1], names[0])).alias("one"))
    first = each.join(components(rows, radius), "fp").groupBy("root").agg(F.min("one").alias("one"))
    chosen = stage(first.select(f"one.{names[0]}", f"one.{names[1]}"), "simhash-chosen")
    release(rows)
    return tagged.join(chosen, list(names), "left_semi").dropDuplicates(list(names)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
