"""BPE encoding and decoding: a minimal acyclic transducer of frequent words, and exact merges for the others.

Frequent words come from the corpus; the automaton shares suffixes, numbers its words, and the number leads to the word's ids.
Its arrays lie in one file that every worker maps into memory. Other words are cut by the public pattern and merged, many at
once, pair by pair in the order of the vocabulary's ranks.
"""

from __future__ import annotations

import atexit
import heapq
import json
import os
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import forget, map_rows, release, small_batches, stage, table, worker_memo

#: Fixed value: the public pattern that cuts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this character the classes of the pattern are the same in all Unicode versions in use.
_STABLE = "԰"
_LATE = regex.compile("[԰-\U0010ffff]")
_NONE = np.int32(1 << 30)


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library. late_split: how that library cuts texts with late characters."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = byte_characters(), spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = 1 + max([*vocab.values(), *self.specials.values()])
        words = [b""] * n
        for token, i in vocab.items():
            words[i] = bytes(chars[c] for c in token)
        for token, i in self.specials.items():
            words[i] = token.encode()
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.byte_id = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._hash(left << 32 | right)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pattern = regex.compile(PATTERN)
        self._library = None

    def _hash(self, keys: np.ndarray) -> None:
        """Open addressing: slots of keys, with the rank of each; probes goes on for the longest run."""
        self.bits = int(np.ceil(np.log2(len(keys) * 6 + 2)))
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        self.probes, at, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.slot_key[at[left]] < 0
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        got = self.slot_key[at]
        out = np.where(got == keys, self.slot_rank[at], _NONE)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.slot_key[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out

    def pieces(self, text: str) -> list[str]:
        """The text as the pattern cuts it."""
        if not _LATE.search(text):
            return self.pattern.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def merge_long(self, word: bytes) -> np.ndarray:
        """One long word: pairs leave a queue by rank, then place."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ranks = self.ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        queue = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < _NONE]
        heapq.heapify(queue)
        known: dict[tuple[int, int], int] = {}
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids):
                    pair = (ids[x], ids[y])
                    if pair not in known:
                        known[pair] = int(self.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if known[pair] < _NONE:
                        heapq.heappush(queue, (known[pair], x, *pair))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def merge(self, words: list[bytes], long: int = 64) -> list[bytes]:
        """The ids of each word, packed as little-endian uint32. All words take a step at a time: their pair of least rank merges."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > long:
                out[i] = self.merge_long(w).tobytes()
            elif w:
                short.append(i)
        if not short:
            return out
        word = np.repeat(np.array(short), [len(words[i]) for i in short])
        sym = self.byte_id[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), _NONE, np.int32)
            if len(sym) > 1:
                same = np.flatnonzero(word[1:] == word[:-1])
                rank[same] = self.ranks(sym[same], sym[same + 1])
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(starts, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, starts), size)
            open_ = least < _NONE
            done_sym.append(sym[~open_])
            done_word.append(word[~open_])
            sel = open_ & (rank == least)
            # of pairs that overlap, as in a run of one symbol, every second merges, from the left
            run = sel.copy()
            run[1:] &= ~sel[:-1]
            at = np.arange(len(sym))
            sel &= (at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0
            sym = np.where(sel, self.merged[np.where(sel, rank, 0)], sym)
            keep = open_.copy()
            keep[1:] &= ~sel[:-1]
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order].astype("<u4"), word[order]
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        packed = sym.tobytes()
        for i, a, b in zip(word[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sym)]):
            out[i] = packed[4 * a : 4 * b]
        return out

    def encode_words(self, words: list[str], lexicon: Lexicon | None = None) -> list[bytes]:
        """Packed ids of texts that are cut and merged for themselves; special strings in them are their ids. Pieces that the lexicon
        has need no merging."""
        cut: list[list[str | int]] = []
        for w in words:
            if self.special is not None and "<" in w and self.special.search(w):
                parts: list[str | int] = []
                at = 0
                for m in self.special.finditer(w):
                    parts += self.pieces(w[at : m.start()])
                    parts.append(self.specials[m[0]])
                    at = m.end()
                cut.append(parts + self.pieces(w[at:]))
            elif _letters(w[1:] if w[:1] == " " else w):
                cut.append([w])
            else:
                cut.append(self.pieces(w))
        number: dict[str, int] = {}
        for parts in cut:
            for p in parts:
                if isinstance(p, str):
                    number.setdefault(p, len(number))
        pieces = [p.encode() for p in number]
        ids = lexicon.find(pieces) if lexicon is not None else [None] * len(pieces)
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.merge([pieces[i] for i in rest])):
            ids[i] = x
        return [b"".join([ids[number[p]] if isinstance(p, str) else np.uint32(p).tobytes() for p in parts]) for parts in cut]

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[ids] - ends + n, n) + np.arange(int(n.sum()))].tobytes().decode("utf-8", "replace")


class Lexicon:
    """Minimal acyclic automaton of words, in arrays: per state its edges (byte, next, words before), and if a word ends there.

    The words before an edge in order add up along a path to the word's number, and that leads to its ids.
    """

    NAMES = ("first", "label", "target", "before", "final", "id_start", "ids")

    @classmethod
    def build(cls, outputs: dict[bytes, bytes]) -> Lexicon:
        """Words in byte order; a state's suffixes are complete when the next word leaves it, and equal states become one."""
        words = sorted(outputs)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, []]]  # open states: final, edges
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth:
                final, edges = path.pop()
                key = (final, tuple(edges))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                if path:
                    path[-1][1][-1] = (path[-1][1][-1][0], register[key])

        for w in words:
            common = next((i for i, (a, b) in enumerate(zip(last, w)) if a != b), min(len(last), len(w)))
            close(common + 1)
            for b in w[common:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = w
        close(0)
        count, before = np.zeros(len(states), np.int64), []
        for i, (final, edges) in enumerate(states):  # states come after those they lead to
            n = int(final)
            for _, to in edges:
                before.append(n)
                n += int(count[to])
            count[i] = n
        sizes = [len(e) for _, e in states]
        self = cls()
        self.first = np.append(0, np.cumsum(sizes)).astype(np.int32)
        self.label = np.array([b for _, e in states for b, _ in e], np.uint8)
        self.target = np.array([t for _, e in states for _, t in e], np.int32)
        self.before = np.array(before, np.int32)
        self.final = np.array([f for f, _ in states], np.uint8)
        self.id_start = np.append(0, np.cumsum([len(outputs[w]) // 4 for w in words])).astype(np.int32)
        self.ids = np.frombuffer(b"".join(outputs[w] for w in words), "<u4")
        return self

    def save(self, path: str) -> None:
        arrays = {n: np.ascontiguousarray(getattr(self, n)) for n in self.NAMES}
        head, at = {}, 0
        for n, a in arrays.items():
            head[n] = [a.dtype.str, len(a), at]
            at += -(-a.nbytes // 8) * 8
        text = json.dumps(head).encode()
        with open(path, "wb") as f:
            f.write(len(text).to_bytes(8, "little") + text + b" " * (-len(text) % 8))
            for a in arrays.values():
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Maps the file into memory: workers on a machine share its pages."""
        whole = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(whole[:8].tobytes(), "little")
        base, self = 8 + n + -n % 8, cls()
        for name, (kind, size, at) in json.loads(whole[8 : 8 + n].tobytes()).items():
            setattr(self, name, whole[base + at : base + at + size * np.dtype(kind).itemsize].view(kind).view(np.ndarray))
        return self

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Packed ids of each word, or None. All words take a byte at a time."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.final) or not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        state, number = np.full(len(words), len(self.final) - 1, np.int64), np.zeros(len(words), np.int64)
        live, depth = np.arange(len(words)), 0
        while len(live):
            ended = size[live] == depth
            for i in live[ended][self.final[state[live[ended]]] > 0].tolist():
                k = number[i]
                out[i] = self.ids[self.id_start[k] : self.id_start[k + 1]].tobytes()
            live = live[~ended]
            byte = flat[start[live] + depth]
            lo, hi = self.first[state[live]].astype(np.int64), self.first[state[live] + 1].astype(np.int64)
            end = hi
            while len(lo) and (open_ := lo < hi).any():  # binary search among the state's edges
                mid = (lo + hi) >> 1
                less = open_ & (self.label[np.minimum(mid, len(self.label) - 1)] < byte)
                lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            ok = lo < end
            ok[ok] = self.label[lo[ok]] == byte[ok]
            live, edge = live[ok], lo[ok]
            number[live] += self.before[edge]
            state[live] = self.target[edge]
            depth += 1
        return out


_SIGNS = ".,;:!?"


def _letters(word: str) -> bool:
    return word.isalpha() and max(word) < _STABLE


class _Memo(dict):
    """Word (lead + key): packed ids. Unknown words are queued; of letters and one sign, the letters: each is a piece.

    size: bytes of memory, about.
    """

    def __init__(self, lead: str, signs: dict[str, bytes]):
        super().__init__()
        self.lead, self.signs, self.queue, self.size = lead, signs, {}, 0

    def __missing__(self, word: str) -> bytes:
        if word[-1] in _SIGNS and _letters(word[:-1]):
            if (ids := self.get(word[:-1])) is not None:
                ids = ids + self.signs[word[-1]]
                self.learn(word, ids)
                return ids
            word = word[:-1]
        self.queue[word] = None
        return b""

    def learn(self, word: str, ids: bytes) -> None:
        self[word] = ids
        self.size += len(word) + len(ids) + 200

    def forget(self) -> None:
        self.clear()
        self.size = 0


class Encoder:
    """Encodes whole texts. most_bytes: of the words that a worker remembers between batches."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, most_bytes: int = 128 << 20):
        self.v, self.lexicon, self.most = vocabulary, lexicon, most_bytes
        signs = dict(zip(_SIGNS, vocabulary.encode_words(list(_SIGNS))))
        self.inner, self.outer = _Memo(" ", signs), _Memo("", signs)
        self.newline = vocabulary.encode_words(["\n"])[0]

    def _learn(self, memo: _Memo) -> None:
        words = [memo.lead + w for w in memo.queue]
        found = self.lexicon.find([w.encode() for w in words]) if self.lexicon else [None] * len(words)
        rest = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(rest, self.v.encode_words([words[i] for i in rest])):
            found[i] = ids
        for word, ids in zip(memo.queue, found):
            memo.learn(word, ids)
        memo.queue = {}

    @staticmethod
    def lines(text: str) -> list[list[str]] | None:
        """Words by line, where each line break and each space stands alone between other characters; else None."""
        words, breaks = text.split(), text.count(" ") + text.count("\n")
        if len(words) != breaks + 1 or len("".join(words)) != len(text) - breaks:
            return None  # spaces side by side or at an end, or others than these
        return [line.split(" ") for line in text.split("\n")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Where spaces and line breaks stand alone, no piece of the pattern goes across one but a space at a word's head."""
        if self.inner.size + self.outer.size > self.most:
            self.inner.forget()
            self.outer.forget()
        plain = [self.lines(t) for t in texts]
        whole = [i for i, (t, p) in enumerate(zip(texts, plain)) if p is None and t]
        out = [b""] * len(texts)
        for _ in range(2):
            self.inner.queue, self.outer.queue = {}, {}
            for i, lines in enumerate(plain):
                if lines is not None and texts[i]:
                    out[i] = self.newline.join([self.outer[words[0]] + b"".join(map(self.inner.__getitem__, words[1:])) for words in lines])
            if not (self.inner.queue or self.outer.queue):
                break
            self._learn(self.inner)
            self._learn(self.outer)
        for i, ids in zip(whole, self.v.encode_words([texts[i] for i in whole], self.lexicon)):
            out[i] = ids
        return out


def frequent_words(docs: DataFrame, keep: int = 65_536) -> list[str]:
    """The most frequent words (between spaces) of all texts, by approximate counts: they choose the lexicon's words, and no id
    depends on them. Of equal counts all or none; null texts have none; an empty table gives none.

    Each partition keeps at most 4 * keep counters: when there are more, the count of the keep-th is taken off all (so that a
    word over 1/keep of the partition's words stays), and hands on the first keep. Counts are then added up.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    n.update(text.split())
            if len(n) > 4 * keep:
                off = sorted(n.values(), reverse=True)[keep]
                n = Counter({w: c - off for w, c in n.items() if c > off})
        top = sorted(n.items(), key=lambda x: (-x[1], x[0]))[:keep]
        for i in range(0, len(top), 8192):
            part = top[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([c for _, c in part], pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word string, n long")
    total = stage(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1 and length(word) <= 64"), "bpe-words")
    # the least count that at most `keep` words have, so that no more than these go to the driver
    by_count = total.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    upto = F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    least = by_count.withColumn("upto", upto).filter(F.col("upto") <= keep).agg(F.min("n")).first()[0]
    words = [r.word for r in total.filter(F.col("n") >= least).select("word").collect()] if least is not None else []
    release(total)
    return sorted(words)


def make_lexicon(vocabulary: Vocabulary, words: list[str]) -> Lexicon:
    """Each word at a text's or line's head, and after a space."""
    both = [w for x in words for w in (x, " " + x)]
    return Lexicon.build(dict(zip([w.encode() for w in both], vocabulary.encode_words(both))))


def share_file(spark: SparkSession, lexicon: Lexicon) -> str:
    """Hand the file to all executors, also those that come later; its name among Spark's files.

    The driver serves the file as long as the application runs, so it stays in the driver's temporary folder until then.
    """
    folder = tempfile.mkdtemp(prefix="flowloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    lexicon.save(path := os.path.join(folder, name))
    spark.sparkContext.addFile(path)
    return name


def encode_documents(docs: DataFrame, vocabulary: str, lexicon: Lexicon | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep; ids, packed as little-endian uint32; decoded, the text that the ids stand for.

    docs has text and the columns of keep; other columns are left out, repeated rows stay, an empty table gives none. Null text:
    as an empty one, no ids. Special strings in a text become their ids, as in the library's encode. vocabulary: a path that
    all machines have.
    """
    name = share_file(docs.sparkSession, lexicon) if lexicon else None

    def rows(cols: dict[str, list]) -> dict[str, list]:
        def make() -> Encoder:
            from pyspark import SparkFiles

            return Encoder(Vocabulary(vocabulary), Lexicon.load(SparkFiles.get(name)) if name else None)

        e = worker_memo(("bpe", vocabulary, name), make)
        ids = e.encode([t or "" for t in cols["text"]])
        return {k: cols[k] for k in keep} | {"ids": ids, "decoded": [e.v.decode(x) for x in ids]}

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return map_rows(docs.select(*keep, "text"), rows, f"{kinds}, ids binary, decoded string", memo=True)


def bpe_encode(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode_documents() with a lexicon of the table's frequent words."""
    lexicon = make_lexicon(Vocabulary(vocabulary), frequent_words(docs))
    return encode_documents(docs, vocabulary, lexicon, keep)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
