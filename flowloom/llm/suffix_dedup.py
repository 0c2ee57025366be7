"""Suffix-array dedup: every byte covered by a string of `width` bytes that also starts elsewhere is removed.

A text's windows of the least width are represented by anchors: the place of the least k-gram hash in a window, which equal
windows share at the same offset. The suffixes and reversed prefixes at anchors, each distinct context once with how often it
occurs, go to a logarithmic family of sparse suffix arrays: a batch of documents becomes a level, a table sorted by suffix and
ranked by prefix; levels of equal size merge, and merging scans them. The common prefixes left and right of an anchor decide for
each window, of each width, if an equal one exists.

Levels are dealt into shards by the anchor's k-gram. A k-gram with very many contexts is dealt by longer and longer strings around
it, down to one window, where equal contexts are one again, so that no shard grows with one k-gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import forget, release, small_batches, stage, table

WIDTH = 400
#: A passage of 51 words is longer than this in the languages here, so that this width finds passages of over 50 words.
PASSAGE = 250
#: Bytes of text that are searched for anchors at a time.
PIECE = 1 << 20
#: Rows of a shard, on average.
SHARD = 4096
_POS = np.uint64((1 << 24) - 1)
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def gram(width: int) -> int:
    return max(2, width // 6)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on, of doubled and then joined parts; the last k - 1 places have none."""
    part, size, out, done = _BYTE[data], 1, None, 0
    base = 0x9E3779B97F4A7C15
    while True:
        if k & size:
            if out is None:
                out, done = part, size
            else:
                n = min(len(out), len(part) - done)
                out, done = out[:n] * np.uint64(pow(base, size, 1 << 64)) + part[done : done + n], done + size
        if done == k:
            break
        part = part[: len(part) - size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2
    out = out[: len(data) - k + 1]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchor_runs(texts: list[bytes], width: int, longest: int | None = None) -> tuple[np.ndarray, ...]:
    """text number, first window, windows, anchor's offset in the first window, bytes of the context (up to the end of the last
    window of `longest` bytes, or of the text), k-gram hash; and the context's name (16 bytes: of its digest, offset and windows)."""
    k, longest = gram(width), longest or width
    found: list[tuple[np.ndarray, ...]] = []
    digests: list[bytes] = []
    parts: list[tuple[int, int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not parts:
            return
        joined = b"".join(p for *_, p in parts)
        hashes = gram_hashes(np.frombuffer(joined, np.uint8), k)
        least = sliding_min((hashes & ~_POS) | np.arange(len(hashes), dtype=np.uint64), width - k + 1)
        at = (least & _POS).astype(np.int64)
        lens = np.array([len(p) for *_, p in parts])
        end = np.cumsum(lens)
        start = end - lens
        for s, e, (_, _, n, _) in zip(start.tolist(), end.tolist(), parts):
            at[s + n : e] = -1  # no window of the piece starts here
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        count = np.diff(np.append(first, len(at)))
        ok = at[first] >= 0
        first, count = first[ok], count[ok]
        of = np.searchsorted(start, first, "right") - 1
        reach = np.minimum(first + count - 1 + longest, end[of])
        base = np.array([b for _, b, _, _ in parts])[of] - start[of]
        found.append((np.array([i for i, *_ in parts])[of], first + base, count, at[first] - first, reach - first, hashes[at[first]].view(np.int64)))
        digests.extend(xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(first.tolist(), reach.tolist()))
        parts.clear()
        size = 0

    for i, text in enumerate(texts):
        for a in range(0, len(text) - width + 1, PIECE):
            piece = text[a : a + PIECE + longest - 1]
            parts.append((i, a, min(PIECE, len(text) - width + 1 - a), piece))
            size += len(piece)
            if size >= PIECE:
                flush()
    flush()
    cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 6
    names = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).copy()
    names[:, 0] += (cols[2] << 32 | cols[3]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (*cols, names.view(np.uint8).reshape(-1, 16))


def anchors(texts: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """key (of the text), first, count, offset, size, g, id: a row per run of windows with one anchor. texts: key, text."""
    small_batches(texts.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            of, first, count, offset, size, g, names = anchor_runs(batch.column(1).cast(pa.binary()).to_pylist(), min(widths), max(widths))
            small = [pa.array(x.astype(np.int32)) for x in (count, offset, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(first), *small, pa.array(g), _strings(names, np.full(len(names), 16))], names=["key", "first", "count", "offset", "size", "g", "id"])

    return texts.mapInArrow(run, "key binary, first long, count int, offset int, size int, g long, id binary")


def _padded(strings: pa.Array, width: int) -> np.ndarray:
    """A row of bytes per string, filled up with zeros."""
    out = np.zeros((len(strings), width), np.uint8)
    if not len(strings):
        return out
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    if ends[-1] > ends[0]:
        out[np.arange(width) < np.diff(ends)[:, None]] = np.frombuffer(strings.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return out


def _strings(rows: np.ndarray, lens: np.ndarray) -> pa.Array:
    """The first lens[i] bytes of each row."""
    offsets = np.append(0, np.cumsum(lens)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows[np.arange(rows.shape[1]) < lens[:, None]].tobytes())])


class Level:
    """Suffixes and reversed prefixes at anchors, in order of both, with the windows that are known to have an equal one.

    right: bytes from the anchor on, room of them; left: those before it, backwards; low, high: least and largest offset of the
    anchor in the row's windows; only: the number of the one width that a row stands for (-1: all); rows: the caller's names.
    hits[i, j, x]: the window of row i with offset x and the j-th width is found elsewhere.
    """

    FIELDS = ("right", "left", "only", "low", "high", "room", "rows", "hits")

    def __init__(self, widths: tuple[int, ...], fields: dict[str, np.ndarray], orders: tuple[np.ndarray, np.ndarray] | None = None):
        """orders: of suffixes and of prefixes. Without them, the rows are a new batch: they are sorted, and scanned."""
        self.widths = widths
        for name in self.FIELDS:
            setattr(self, name, fields[name])
        self.r_order, self.l_order = orders or tuple(np.argsort(self._keys(x), kind="stable") for x in (self.right, self.left))
        if orders is None:
            self.scan()

    def __len__(self) -> int:
        return len(self.rows)

    @staticmethod
    def _keys(strings: np.ndarray) -> np.ndarray:
        return strings.view(f"S{strings.shape[1]}").ravel()

    @classmethod
    def of(cls, contexts: list[bytes], offset: np.ndarray, count: np.ndarray, rows: np.ndarray, widths: tuple[int, ...]) -> Level:
        reach, n = min(widths) - gram(min(widths)) + 1, len(contexts)
        right = _padded(pa.array([c[o:] for c, o in zip(contexts, offset.tolist())], pa.binary()), max(widths))
        left = _padded(pa.array([c[:o][::-1] for c, o in zip(contexts, offset.tolist())], pa.binary()), reach)
        room = np.array([len(c) for c in contexts]) - offset
        return cls(widths, {"right": right, "left": left, "only": np.full(n, -1), "low": offset - count + 1, "high": offset, "room": room, "rows": rows, "hits": np.zeros((n, len(widths), reach), bool)})

    def merge(self, other: Level) -> Level:
        """Both orders are merged, and the level that results is scanned."""
        orders = []
        for strings, order in (("right", "r_order"), ("left", "l_order")):
            a, b = getattr(self, order), getattr(other, order)
            at = np.searchsorted(self._keys(getattr(self, strings)[a]), self._keys(getattr(other, strings)[b]), "right") + np.arange(len(b))
            both = np.empty(len(a) + len(b), np.int64)
            both[at] = b + len(a)
            rest = np.ones(len(both), bool)
            rest[at] = False
            both[rest] = a
            orders.append(both)
        out = Level(self.widths, {f: np.concatenate([getattr(self, f), getattr(other, f)]) for f in self.FIELDS}, tuple(orders))
        out.scan()
        return out

    @staticmethod
    def _common(strings: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common prefix of each string with the one before it in the order (the first: 0), and the longest one of each row."""
        there = strings[order]
        differ = there[1:] != there[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
        lcp = np.append(0, common)
        best = np.zeros(len(order), np.int64)
        best[order] = np.maximum(lcp, np.append(common, 0))
        return lcp, best

    def scan(self) -> None:
        """Windows are equal if they have the anchor at one offset x and agree on x bytes before and width - x from it on: two
        rows do so exactly if they are in one class of common prefixes on both sides."""
        if len(self) < 2:
            return
        r_lcp, r_best = self._common(self.right, self.r_order)
        l_lcp, l_best = self._common(self.left, self.l_order)
        right, left = np.empty(len(self), np.int64), np.empty(len(self), np.int64)
        for j, width in enumerate(self.widths):
            # offsets that a row can match at: at most its best common prefix on the left, at least width less that on the right
            low, high = np.maximum(np.maximum(self.low, width - self.room), width - r_best), np.minimum(self.high, l_best)
            able = (low <= high) & ((self.only < 0) | (self.only == j))
            if not able.any():
                continue
            for x in range(int(low[able].min()), int(high[able].max()) + 1):
                rows = np.flatnonzero(able & (low <= x) & (x <= high))
                if len(rows) < 2 or self.hits[rows, j, x].all():
                    continue
                right[self.r_order] = np.cumsum(r_lcp < width - x)
                left[self.l_order] = np.cumsum(l_lcp < x)
                both = right[rows] * (len(self) + 1) + left[rows]
                order = np.argsort(both)
                same = both[order[1:]] == both[order[:-1]]
                self.hits[rows[order[1:][same]], j, x] = True
                self.hits[rows[order[:-1][same]], j, x] = True


class LevelFamily:
    """A batch is a level; two levels of like size (by powers of two) merge, and merging scans them for matches."""

    def __init__(self, widths: int | tuple[int, ...]):
        self.widths, self.levels = (widths,) if isinstance(widths, int) else widths, []

    def add(self, contexts: list[bytes], offset: np.ndarray, count: np.ndarray, rows: np.ndarray) -> None:
        self.levels.append(Level.of(contexts, offset, count, rows, self.widths))
        while len(self.levels) > 1 and len(self.levels[-2]).bit_length() <= len(self.levels[-1]).bit_length():
            self.levels.append(self.levels.pop().merge(self.levels.pop()))

    def finish(self) -> Level | None:
        """All levels in one, the least first."""
        while len(self.levels) > 1:
            self.levels.append(self.levels.pop().merge(self.levels.pop()))
        return self.levels.pop() if self.levels else None


#: Of a level's table: shard, place among the suffixes and among the prefixes (null: not yet sorted), and the row (see Level; id is
#: a context's name, n how many there are of it).
_ROW = "id binary, g long, only int, low int, high int, room int, right binary, left binary, n long"
_LEVEL = "shard int, pos int, lpos int, id binary, only int, low int, high int, room int, right binary, left binary, hits binary"


class SuffixFamily:
    """Levels as tables in the shared folder. add() sorts a batch of contexts into a level; with existing levels of like size it is
    merge-scanned and becomes one with them, in the same job. A lost executor costs a few shards of the job that runs.

    shards: among which k-grams are dealt, for good; each is merged by one task at a time, in memory. Contexts are _ROW columns; a
    repeated id within a batch is one row, and an id is to be in one batch only.
    """

    def __init__(self, spark: SparkSession, widths: tuple[int, ...], shards: int):
        self.spark, self.widths, self.shards = spark, widths, shards
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, contexts: DataFrame, rows: int) -> None:
        taken = []
        while self.levels and self.levels[-1][0].bit_length() <= max(1, rows).bit_length():
            n, level = self.levels.pop()
            taken.append(level)
            rows += n
        new = contexts.select(F.pmod(F.xxhash64("g"), F.lit(self.shards)).cast("int").alias("shard"), F.lit(0).alias("tag"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("lpos"), "id", "only", "low", "high", "room", "right", "left", F.when(F.col("n") > 1, F.lit(b"+")).alias("hits"))
        self.levels.append((rows, self._merged([new, *taken])))
        release(*taken)

    def finish(self) -> DataFrame:
        """id, j (of the width), x0, x1 (first and last offset): the windows that have an equal one, after all levels have met."""
        if len(self.levels) > 1:
            rows, taken = sum(n for n, _ in self.levels), [level for _, level in self.levels]
            self.levels = [(rows, self._merged(taken[::-1]))]
            release(*taken)
        widths, reach = self.widths, min(self.widths) - gram(min(self.widths)) + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in batches:
                hits = _unpacked(batch.column(1), len(widths), reach)
                edge = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (0, 0), (1, 1))), axis=2)
                row, j, begin = np.nonzero(edge == 1)
                end = np.nonzero(edge == -1)[2]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *[pa.array(x.astype(np.int32)) for x in (j, begin, end - 1)]], names=["id", "j", "x0", "x1"])

        small_batches(self.spark)
        return self.levels[0][1].select("id", "hits").mapInArrow(run, "id binary, j int, x0 int, x1 int")

    def _merged(self, tables: list[DataFrame]) -> DataFrame:
        """One level of all tables, the smallest first; the first may be a new batch."""
        widths, reach = self.widths, min(self.widths) - gram(min(self.widths)) + 1
        small_batches(self.spark)

        def level(parts: list[pa.RecordBatch]) -> tuple[Level, pa.Array]:
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            ids = t.column("id")
            fresh = t.column("pos").null_count > 0
            if fresh:  # copies of a text may have brought a context twice; they follow each other
                names = np.array(ids.to_pylist(), object)
                t = t.filter(pa.array(np.append(True, names[1:] != names[:-1])))
                ids = t.column("id")
            fields = {f: t.column(f).to_numpy().astype(np.int64) for f in ("only", "low", "high", "room")}
            if fresh:
                n = t.column("hits").is_valid().to_numpy(zero_copy_only=False)  # a context that occurs twice: each window does
                x = np.arange(reach)
                hits = np.stack([n[:, None] & (x >= np.maximum(fields["low"], w - fields["room"])[:, None]) & (x <= fields["high"][:, None]) & ((fields["only"] < 0) | (fields["only"] == j))[:, None] for j, w in enumerate(widths)], axis=1)
            else:
                hits = _unpacked(t.column("hits"), len(widths), reach)
            fields |= {"right": _padded(t.column("right"), max(widths)), "left": _padded(t.column("left"), reach), "rows": np.arange(t.num_rows), "hits": hits}
            return Level(widths, fields, None if fresh else (np.arange(t.num_rows), np.argsort(t.column("lpos").to_numpy()))), ids

        def shard(number: int, tags: dict[int, list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
            one, names = None, None
            for tag in sorted(tags):
                now, ids = level(tags[tag])
                if one is not None:
                    now.rows += len(one)
                    now, ids = one.merge(now), pa.concat_arrays([names, ids])
                one, names = now, ids
            lpos = np.empty(len(one), np.int32)
            lpos[one.l_order] = np.arange(len(one))
            o, place = one.r_order, np.empty(len(one), np.int32)
            place[o] = np.arange(len(one))
            packed = np.packbits(one.hits[o].reshape(len(o), -1), axis=1)
            ints = [pa.array(getattr(one, f)[o].astype(np.int32)) for f in ("only", "low", "high", "room")]
            cols = [pa.array(np.full(len(o), number, np.int32)), pa.array(np.arange(len(o), dtype=np.int32)), pa.array(lpos[o]), names.take(pa.array(one.rows[o])), *ints, _strings(one.right[o], one.room[o]), _strings(one.left[o], one.high[o]), _strings(packed, np.full(len(o), packed.shape[1]))]
            whole = pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _LEVEL.split(", ")])
            for a in range(0, len(o), 4096):
                yield whole.slice(a, 4096)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            at, tags = None, {}
            for batch in batches:
                keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    number, tag = keys[a].tolist()
                    if number != at and tags:
                        yield from shard(at, tags)
                        tags = {}
                    at = number
                    tags.setdefault(tag, []).append(batch.slice(a, b - a))
            if tags:
                yield from shard(at, tags)

        names = ["shard", "tag", "pos", "lpos", "id", "only", "low", "high", "room", "right", "left", "hits"]
        rows = None
        for i, t in enumerate(tables):
            t = t.select([F.lit(i).alias("tag") if c == "tag" else F.col(c) for c in names])
            rows = t if rows is None else rows.unionByName(t)
        dealt = rows.repartition("shard").sortWithinPartitions("shard", "tag", "pos", "id")
        return stage(dealt.mapInArrow(run, _LEVEL), "dedup-level")


def _unpacked(hits: pa.Array, n_widths: int, reach: int) -> np.ndarray:
    size = -(-n_widths * reach // 8)
    return np.unpackbits(_padded(hits, size), axis=1)[:, : n_widths * reach].reshape(-1, n_widths, reach).astype(bool)


def _lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of arrays of structs: where each row's begin, with the end of the last, and the fields of all."""
    begin = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(int(begin[0]), int(begin[-1] - begin[0])) if len(begin) else column.values
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(begin))
    assert int(sizes.sum()) == len(flat)
    return np.append(0, np.cumsum(sizes)), [flat.field(f) for f in fields]


def _contexts(texts: DataFrame, classes: DataFrame, widths: tuple[int, ...], batches: int) -> DataFrame:
    """_ROW and batch (of the document): the bytes of each class's one run (id, g, n, key, first, count, offset, size). A text that
    several rows of texts have may bring its contexts more than once."""
    per_text = classes.groupBy("key").agg(F.collect_list(F.struct("id", "g", "n", "first", "count", "offset", "size")).alias("runs"))
    small_batches(texts.sparkSession, 500)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        last = None
        for batch in batches_:
            begin, (ids, g, n, first, count, offset, size) = _lists(batch.column(2), "id", "g", "n", "first", "count", "offset", "size")
            first, count, offset, size = (x.to_numpy() for x in (first, count, offset, size))
            use, part, right, left = [], [], [], []
            texts_ = batch.column(1).cast(pa.binary())
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key != last:  # copies mostly follow each other
                    a, b = int(begin[i]), int(begin[i + 1])
                    text = texts_[i].as_py()
                    for f, o, s in zip(first[a:b].tolist(), offset[a:b].tolist(), size[a:b].tolist()):
                        right.append(text[f + o : f + s])
                        left.append(text[f : f + o][::-1])
                    use.append(np.arange(a, b))
                    part.append(np.full(b - a, int.from_bytes(key[:4], "little") % batches, np.int32))
                last = key
            at = np.concatenate([*use, np.zeros(0, np.int64)])
            take = pa.array(at)
            ints = [pa.array(x.astype(np.int32)) for x in (np.full(len(at), -1), offset[at] - count[at] + 1, offset[at], size[at] - offset[at])]
            yield pa.RecordBatch.from_arrays([ids.take(take), g.take(take), *ints, pa.array(right, pa.binary()), pa.array(left, pa.binary()), n.take(take), pa.array(np.concatenate([*part, np.zeros(0, np.int32)]))], names=[*[c.split()[0] for c in _ROW.split(", ")], "batch"])

    return texts.join(per_text, "key").select("key", "text", "runs").mapInArrow(run, f"{_ROW}, batch int")


def _finer(rows: DataFrame, widths: tuple[int, ...], band: int) -> DataFrame:
    """The rows, by one width and band of `band` offsets each, with what windows at these offsets see only; g is then of the bytes
    that all of them see, and id of all that the row has. parent: the row's id before."""
    wide = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(w).alias("w")) for j, w in enumerate(widths)])
    cut = rows.withColumn("wide", F.explode(wide)).filter("only < 0 or only = wide.j").withColumn("low", F.greatest("low", F.col("wide.w") - F.col("room"))).filter("low <= high")
    cut = cut.withColumn("band", F.explode(F.sequence(F.floor(F.col("low") / band).cast("int"), F.floor(F.col("high") / band).cast("int"))))
    cut = cut.withColumn("low", F.greatest("low", F.col("band") * band)).withColumn("high", F.least("high", (F.col("band") + 1) * band - 1))
    cut = cut.withColumn("right", F.substring("right", F.lit(1), F.col("wide.w") - F.col("low"))).withColumn("left", F.substring("left", F.lit(1), F.col("high")))
    last = F.least((F.col("band") + 1) * band - 1, F.lit(min(widths) - gram(min(widths))))
    core = F.md5(F.concat(F.substring("left", F.lit(1), F.col("band") * band), F.lit(b"|"), F.substring("right", F.lit(1), F.col("wide.w") - last)))
    whole = F.md5(F.concat("left", F.lit(b"|"), "right"))
    cut = cut.withColumn("parent", F.col("id")).withColumn("only", F.col("wide.j")).withColumn("room", F.octet_length("right"))
    cut = cut.withColumn("id", F.unhex(F.md5(F.concat_ws(":", whole, *[F.col(c).cast("string") for c in ("only", "low", "high")]).cast("binary")))).withColumn("g", F.xxhash64(core, "only", "band", F.lit(band)))
    return cut.select(*[c.split()[0] for c in _ROW.split(", ")], "batch", "parent")


def _dealt(contexts: DataFrame, widths: tuple[int, ...], hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """The contexts, those of a k-gram with more than `hot` of them by finer g, and per round the table of id and parent.

    Each round halves the offsets that a row stands for. Contexts that are equal there become one, whose n adds up, before they are
    shuffled; those alone with their g have no match and go. At one offset, all that is left of a g is one context.
    """
    parents: list[DataFrame] = []
    reach = min(widths) - gram(min(widths)) + 1
    band, done, now = 1 << (reach - 1).bit_length(), [], contexts
    names = [c.split()[0] for c in _ROW.split(", ")] + ["batch"]
    while True:
        frequent = stage(now.groupBy("g").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") > hot).select("g"), "dedup-frequent")
        if band == 1 or frequent.isEmpty():
            done.append(now)
            break
        done.append(now.join(frequent, "g", "left_anti").select(names))
        band //= 2
        cut = stage(_finer(now.join(frequent, "g", "left_semi").select(names).dropDuplicates(["id"]), widths, band), "dedup-finer")
        parents.append(cut.select("id", "parent"))
        one = cut.groupBy("id").agg(F.sum("n").alias("n"), *[F.any_value(c).alias(c) for c in names if c not in ("id", "n")])
        alone = one.groupBy("g").agg(F.sum("n").alias("total")).filter("total > 1").select("g")
        now = stage(one.join(alone, "g", "left_semi").select(names), "dedup-finer")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, parents


def repeated_windows(texts: DataFrame, widths: tuple[int, ...] = (WIDTH,), hot: int = SHARD, batches: int = 4) -> DataFrame:
    """key, j, first, count: runs of windows (of the j-th width) of a text that start elsewhere too. texts: key (a digest of the text)
    and text, a row per document, so that copies count as elsewhere. hot: contexts of a k-gram from which it is dealt by more
    bytes. batches: of documents, each a level at first."""
    spark = texts.sparkSession
    runs = stage(anchors(texts, widths), "dedup-anchors")
    # as tables of their own, these sides leave their joins free to split a frequent k-gram
    several = stage(runs.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g"), "dedup-several")
    shared = stage(runs.join(several, "g", "left_semi").select("key", "first", "count", "offset", "size", "g", "id"), "dedup-shared")
    release(runs, several)
    classes = shared.groupBy("id", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "count", "offset", "size")).alias("one")).select("id", "g", "n", "one.*")
    contexts = stage(_contexts(texts, classes, widths, batches), "dedup-contexts")
    dealt, parents = _dealt(contexts, widths, hot)
    sizes = {r.batch: r.n for r in dealt.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    family = SuffixFamily(spark, widths, -(-sum(sizes.values()) // SHARD))
    for b in sorted(sizes):
        family.add(dealt.filter(F.col("batch") == b), sizes[b])
    if not sizes:
        return spark.createDataFrame([], "key binary, j int, first long, count int")
    release(contexts)
    hits = stage(family.finish(), "dedup-hits")
    release(*[level for _, level in family.levels])
    for p in reversed(parents):
        up = hits.join(p, "id").select(F.col("parent").alias("id"), "j", "x0", "x1")
        hits = hits.unionByName(up)
    first = (F.col("first") + F.col("offset") - F.col("x1")).alias("first")  # the largest offset is the first window
    found = shared.join(hits, "id").select("key", "j", first, (F.col("x1") - F.col("x0") + 1).cast("int").alias("count")).distinct()
    out = stage(found, "dedup-windows")
    release(shared, hits)
    return out


def text_key(text: str = "text") -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _covered(first: np.ndarray, count: np.ndarray, width: int) -> list[list[int]]:
    """Start and end of the maximal runs of bytes in the windows."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate((first + count + width - 1)[order])
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1])) if len(start) else np.zeros(0, np.int64)
    return [[a, b] for a, b in zip(start[new].tolist(), end[np.append(new[1:], len(start)) - 1].tolist())] if len(new) else []


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",), hot: int = SHARD, whole_characters: bool = False, also: int | None = None, batches: int = 4) -> DataFrame:
    """The columns of keep; n_bytes, n_removed, spans (start and end of each removed run), kept (the bytes that are left); n_also, the
    bytes that strings of `also` bytes cover, which start elsewhere too (null without such a width).

    docs has text and the columns of keep; other columns are left out. Null text: as an empty one. Repeated rows are documents of
    their own, so each is the other's copy. Texts under `width` bytes stay whole. An empty table gives none. whole_characters:
    removed runs shrink to whole UTF-8 characters, so that what is left is text.
    """
    widths = (width, also) if also else (width,)
    texts = docs.select(text_key().alias("__key"), F.coalesce(F.col("text"), F.lit("")).alias("__text"), *keep)
    windows = repeated_windows(texts.select(F.col("__key").alias("key"), F.col("__text").alias("text")), widths, hot, batches)
    per_text = windows.groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("j", "first", "count")).alias("__runs"))
    joined = texts.join(per_text, "__key", "left").select(*keep, "__text", "__runs")
    small_batches(docs.sparkSession, 500)
    kinds = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches_:
            begin, (j, first, count) = _lists(batch.column(len(keep) + 1), "j", "first", "count")
            j, first, count = j.to_numpy(), first.to_numpy(), count.to_numpy()
            total, removed, all_spans, kept, more = [], [], [], [], []
            for i, text in enumerate(batch.column(len(keep)).cast(pa.binary())):
                text = text.as_py()
                a, b = int(begin[i]), int(begin[i + 1])
                spans, *others = [_covered(first[a:b][j[a:b] == n], count[a:b][j[a:b] == n], w) for n, w in enumerate(widths)]
                if whole_characters:
                    for s in spans:
                        while s[0] < len(text) and text[s[0]] & 0xC0 == 0x80:
                            s[0] += 1
                        while s[1] < len(text) and text[s[1]] & 0xC0 == 0x80:
                            s[1] -= 1
                    spans = [s for s in spans if s[0] < s[1]]
                edges = [0, *[x for s in spans for x in s], len(text)]
                left = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
                total.append(len(text))
                removed.append(len(text) - len(left))
                all_spans.append([{"start": a, "end": b} for a, b in spans])
                kept.append(left)
                more.append(sum(b - a for a, b in others[0]) if others else None)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [*[batch.column(i) for i in range(len(keep))], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(all_spans, span), pa.array(kept, pa.binary()), pa.array(more, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_bytes", "n_removed", "spans", "kept", "n_also"])

    return joined.mapInArrow(run, f"{kinds}n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary, n_also long")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated strings taken out of the texts (null stays null) and n_chars, if there is one, as it is then."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    inner = docs.select("text", F.col("text").isNull().alias("__null"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(others)])
    got = remove_repeats(inner, width, ("__null", *[f"__c{i}" for i in range(len(others))]), whole_characters=True)
    text = F.when(~F.col("__null"), F.decode("kept", "UTF-8"))
    named = {c: F.col(f"__c{i}") for i, c in enumerate(others)} | {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return got.select(*[named[c].alias(c) for c in docs.columns])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns at 400 bytes, and n_repeated: the bytes in strings of PASSAGE bytes that start elsewhere too."""
    got = remove_repeats(table(spark, sf_dir, "documents"), also=PASSAGE)
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("n_also").alias("n_repeated"))
