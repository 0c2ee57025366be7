"""Token-id files: documents' ids in ascending doc_id order, range-coded in checked blocks, written and read by Spark.

A file's row is a chunk of whole documents: their ids' counts, and blocks that are reset, and checked by a CRC, for themselves.
Any store that Spark writes to will do, and a lost task is only written again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.bpe import byte_characters
from flowloom.llm.common import delete_at_exit, forget, shared_dir, small_batches, stage, table, worker_memo
from flowloom.llm.range_coder import BLOCK, LANES, Prior, decode_ids, encode_ids

#: Fixed value: the public pattern of the vocabulary's words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
MAGIC = b"TIDS\x02\0\0\0"
CHUNK_IDS = BLOCK * LANES
_HEAD = "<IIIIIQ"
#: Texts are tokenised together up to so many bytes (one text may be longer): the more, the fewer lookups a word.
GROUP_BYTES = 8 << 20
#: ASCII signs, of which the pattern makes words that no letter is in, wherever no letter follows.
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_PACKERS = [struct.Struct(f"<{n}H").pack for n in range(64)]
#: Up to so many chunks (of about 8 million ids each), the table of their places is broadcast; beyond, the join shuffles.
BROADCAST_CHUNKS = 100_000


def pack_chunk(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """MAGIC; documents, blocks, ids per block, and the prior's bytes and CRC-32 (uint32); the ids in all (uint64); the prior, which
    every block is reset to; per document its id, if it is null, and its count (int64, uint8, uint64); per block its bytes and the
    CRC-32 of its ids as uint32 (uint32 each); the blocks."""
    prior = Prior(ids)
    first = prior.pack()
    blocks = encode_ids(ids, BLOCK, prior)
    wide = ids.astype("<u4").tobytes()
    checks = [zlib.crc32(wide[4 * BLOCK * i : 4 * BLOCK * (i + 1)]) for i in range(len(blocks))]
    head = MAGIC + struct.pack(_HEAD, len(doc_ids), len(blocks), BLOCK, len(first), zlib.crc32(first), len(ids)) + first
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array(counts, "<u8").tobytes()
    return b"".join([head, docs, np.array([len(b) for b in blocks], "<u4").tobytes(), np.array(checks, "<u4").tobytes(), *blocks])


def unpack_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, counts and ids (uint32). A block that does not match its CRC is an error."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id chunk")
    n_docs, n_blocks, block, n_first, check, n_ids = struct.unpack_from(_HEAD, data, 8)
    at = 8 + struct.calcsize(_HEAD) + n_first
    if zlib.crc32(first := data[at - n_first : at]) != check:
        raise ValueError("the prior is damaged")

    def column(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    docs, null, counts = column("<i8", n_docs), column("u1", n_docs), column("<u8", n_docs).astype(np.int64)
    sizes, checks = column("<u4", n_blocks), column("<u4", n_blocks)
    ends = at + np.cumsum(sizes, dtype=np.int64)
    blocks = [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    ids = decode_ids(blocks, n_ids, block, Prior.unpack(first)).astype("<u4")
    wide = ids.tobytes()
    for i, c in enumerate(checks.tolist()):
        if zlib.crc32(wide[4 * block * i : 4 * block * (i + 1)]) != c:
            raise ValueError(f"block {i} is damaged")
    return [None if z else d for d, z in zip(docs.tolist(), null.tolist())], counts, ids


class _Words(dict):
    """Word between ASCII spaces: its ids, packed as uint16, from the tokenizers library. size: bytes of memory, about."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.pattern = regex.compile(PATTERN)
        self.characters = {b: c for c, b in byte_characters().items()}
        self.size = 0

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # ASCII letters are a word of the pattern, and the library's model alone makes its ids
            out = self._pack([t.id for t in self.model.tokenize(word.decode())])
        elif (base := word.rstrip(_SIGNS.encode())) != word and base.isalpha():  # signs after letters are one for themselves
            out = self[base] + self[word[len(base) :]]
        else:
            out = self._other(word.decode())
        self[word] = out
        self.size += len(word) + len(out) + 160
        return out

    def _other(self, text: str) -> bytes:
        """Latin text has one form of each letter, and small ones as in Python; its words under the pattern are kept each for itself.
        Anything else goes through the library as a whole."""
        if max(text, default="") >= "\u0250" or "<|" in text:
            return self._pack(self.library.encode(text, add_special_tokens=False).ids)
        text = text.lower()
        if (base := text.rstrip(_SIGNS)) != text and base.isalpha():
            return self[base.encode()] + self[text[len(base) :].encode()]
        if text.isalpha() or (parts := self.pattern.findall(text)) == [text]:
            return self._pack([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.characters))])
        return b"".join([self[p.encode()] for p in parts])

    def _pack(self, ids: list[int]) -> bytes:
        try:
            return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}H", *ids)
        except struct.error:
            raise ValueError("ids from 65536 on are not supported") from None

    def bound(self, most_bytes: int, last: list[bytes], ids: list[bytes]) -> None:
        """Beyond most_bytes, keep only the words of the last call, which the frequent ones are among; or none, if they are too many."""
        if self.size > most_bytes:
            self.clear()
            self.size = sum(map(len, last)) + sum(map(len, ids)) + 160 * len(last)
            if self.size > most_bytes:
                self.size = 0
            else:
                self.update(zip(last, ids))


def tokenise(texts: pa.StringArray, vocabulary: str, most_bytes: int = 128 << 20) -> list[bytes]:
    """Packed ids (uint16) of each text under a vocabulary that drops white space and case: no normaliser or pattern of it looks
    across a space, so each word between spaces is encoded for itself, and remembered by the worker, in most_bytes and what one
    call adds. Words are looked up once a call. ASCII letters are made small first (but where a special string may stand), so that
    fewer words differ."""
    words = worker_memo(("token files", vocabulary), lambda: _Words(vocabulary))
    texts = texts.fill_null("")
    found = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    coded = found.values.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    known = list(map(words.__getitem__, distinct))
    words.bound(most_bytes, distinct, known)
    ids = pa.array(known, pa.large_binary()).take(coded.indices)
    _, ends, packed = ids.buffers()
    if not len(ids):
        return [b""] * len(texts)
    at = np.frombuffer(ends, np.int64)[ids.offset + found.offsets.to_numpy()].tolist()
    packed = memoryview(packed) if packed else b""
    return [bytes(packed[a:b]) for a, b in zip(at, at[1:])]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches that follow each other, of GROUP_BYTES together, or one."""
    group, size = [], 0
    for batch in batches:
        if group and size + batch.nbytes > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(batch)
        size += batch.nbytes
    if group:
        yield group


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Write part, chunk, n_ids and payload (pack_chunk) to path, in ascending order of doc_id (nulls first) over the parts.

    docs has doc_id (an integer) and text; other columns are left out. Null text: only the end id. Repeated ids are ordered by
    their texts. An empty table gives files without rows.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk = TaskContext.get().partitionId(), 0
        ids, doc_ids, counts, held = [], [], [], 0
        end = struct.pack("<H", end_id)

        def flush() -> pa.RecordBatch:
            nonlocal ids, doc_ids, counts, held, chunk
            payload = pack_chunk(doc_ids, counts, np.frombuffer(b"".join(ids), "<u2"))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], names=["part", "chunk", "n_ids", "payload"])
            ids, doc_ids, counts, held, chunk = [], [], [], 0, chunk + 1
            return out

        for group in _groups(batches):
            for d, packed in zip(pa.concat_arrays([b.column(0) for b in group]).to_pylist(), tokenise(pa.concat_arrays([b.column(1) for b in group]), vocabulary)):
                n = len(packed) // 2 + 1
                if held and held + n > CHUNK_IDS:
                    yield flush()
                ids += (packed, end)
                doc_ids.append(d)
                counts.append(n)
                held += n
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text").drop("h")
    ordered.mapInArrow(run, "part int, chunk int, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (packed as little-endian uint32), from the files."""
    small_batches(spark, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part, chunk, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids, counts, ids = unpack_chunk(payload)
                ends = np.cumsum(counts)
                packed = ids.tobytes()
                for a in range(0, len(doc_ids), 2000):
                    part_ends = ends[a : a + 2000].tolist()
                    starts = (ends - counts)[a : a + 2000].tolist()
                    n = len(part_ends)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[a : a + 2000], pa.int64()), pa.array([part] * n, pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array([packed[4 * x : 4 * y] for x, y in zip(starts, part_ends)], pa.binary())],
                        names=["doc_id", "part", "chunk", "within", "ids"],
                    )

    files = spark.read.schema("part int, chunk int, n_ids long, payload binary").parquet(path)
    order = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(files.select("part", "chunk", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before")), "token-offsets")
    if offsets.count() <= BROADCAST_CHUNKS:
        offsets = F.broadcast(offsets)
    decoded = files.select("part", "chunk", "payload").mapInArrow(run, "doc_id long, part int, chunk int, within long, ids binary")
    return decoded.join(offsets, ["part", "chunk"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "ids")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    got = read_token_files(spark, path)
    return got.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
