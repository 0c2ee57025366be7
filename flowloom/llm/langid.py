"""Language identification by partial matching: byte context trees per language give code lengths under frozen counts.

One tree holds the contexts of all languages, with a count per language at each node. A byte's code length under a language
is that of its longest context with counts, where the byte was seen (method C), else that context's escape plus the length
under the next shorter one, down to 8 bits. As the counts are frozen, each node's lengths are worked out once, and a text is
scored with array look-ups along the tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import map_rows, release, stage, table

_LETTER = re.compile(r"[^\W\d_]")


class ContextTree:
    """order: bytes of the longest context. Learns from {language: texts}; holds arrays only, of a size the texts bound."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = 3):
        self.languages, self.order = sorted(texts), order
        n_lang = max(1, len(self.languages))
        data = [b"".join(texts[lang]) for lang in self.languages]
        raw = np.frombuffer(b"".join(data), np.uint8)
        lang = np.repeat(np.arange(len(data)), [len(d) for d in data])
        first = np.zeros(len(raw), bool)
        sizes = np.array([len(t) for lang_ in self.languages for t in texts[lang_]], np.int64)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        depth = np.arange(len(raw)) - np.maximum.accumulate(np.where(first, np.arange(len(raw)), 0))  # bytes before in the text
        #: 0: a byte never seen; the last symbol stands between texts.
        self.symbol = np.zeros(256, np.int32)
        seen = np.unique(raw)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 2
        sym = self.symbol[raw].astype(np.int64)
        node = np.zeros(len(raw), np.int64)  # of the context before the byte, at this level
        self.codes: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        shorter = None
        at = np.arange(len(raw))
        for level in range(1, order + 2):
            ok = depth[at] >= level - 1
            at, node = at[ok], node[ok]
            codes, child = np.unique(node * self.width + sym[at], return_inverse=True)
            count = np.zeros((len(codes), n_lang))
            np.add.at(count, (child, lang[at]), 1)
            parent = codes // self.width
            n_parents = 1 if level == 1 else len(self.codes[-1])
            total, kinds = np.zeros((n_parents, n_lang)), np.zeros((n_parents, n_lang))
            np.add.at(total, parent, count)
            np.add.at(kinds, parent, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                own = np.log2((total + kinds)[parent] / count)
            if level == 1:
                back = np.full((len(codes), n_lang), 8.0)
            else:
                suffix = np.zeros(len(codes), np.int64)
                suffix[child] = shorter[at]
                back = self.cost[-1][suffix]
            self.codes.append(codes)
            self.escape.append(escape)
            self.cost.append(np.where(count > 0, own, escape[parent] + back))
            full = np.full(len(raw), -1, np.int64)
            full[at] = child
            shorter = full
            # the context of the next level's byte is this level's string one byte before
            at = np.arange(1, len(raw)) if len(raw) else at
            node = full[:-1] if len(raw) else node
            keep = (node >= 0) & (depth[at] >= level)
            at, node = at[keep], node[keep]
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def tables(self) -> list[np.ndarray]:
        """Per level, the child of (context, symbol); a context's number past the last is one without children."""
        if self._tables is None:
            self._tables = []
            for level, codes in enumerate(self.codes):
                parents = 1 if level == 0 else len(self.codes[level - 1])
                t = np.full((parents + 1) * self.width, len(codes), np.int32)
                t[codes] = np.arange(len(codes), dtype=np.int32)
                self._tables.append(t)
            zero = np.zeros((1, max(1, len(self.languages))))
            self._cost = [np.vstack([c, zero]) for c in self.cost]
            self._escape = [np.vstack([e, zero]) for e in self.escape]
        return self._tables

    def lengths(self, sym: np.ndarray) -> np.ndarray:
        """Bits of each symbol under each language, its contexts being the symbols before; a separator costs nothing."""
        tables, n = self.tables(), len(sym)
        at = []
        node = np.zeros(n, np.int64)
        for level, t in enumerate(tables):
            if level:
                node = np.empty(n, np.int64)
                node[0] = len(self.codes[level - 1])
                node[1:] = at[-1][:-1]
            at.append(t[node * self.width + sym])
        top = len(tables) - 1
        bits = self._cost[top][at[top]]
        left = np.flatnonzero(at[top] == len(self.codes[top]))
        for level in range(top, -1, -1):
            if level < top:
                hit = at[level][left] != len(self.codes[level])
                bits[left[hit]] += self._cost[level][at[level][left[hit]]]
                left = left[~hit]
            if not len(left):
                break
            if level:
                before = np.where(left > 0, at[level - 1][left - 1], len(self.codes[level - 1]))
                bits[left] += self._escape[level][before]
            else:
                bits[left] += self._escape[0][0] + 8.0
        bits[sym == self.width - 1] = 0.0
        return bits

    def score(self, texts: list[bytes], piece: int = 1 << 19) -> np.ndarray:
        """Code length in bits of each whole text under each language; texts are taken in pieces, contexts go on across them."""
        out = np.zeros((len(texts), max(1, len(self.languages))))
        parts: list[np.ndarray] = []
        spans: list[tuple[int, int, int]] = []
        size, gap = 0, np.array([self.width - 1], np.int32)

        def flush() -> None:
            nonlocal size
            if spans:
                sums = np.add.reduceat(np.vstack([self.lengths(np.concatenate(parts)), np.zeros((1, out.shape[1]))]), [x for s in spans for x in s[1:]], axis=0)[::2]
                np.add.at(out, [s[0] for s in spans], sums)
            parts.clear()
            spans.clear()
            size = 0

        for i, text in enumerate(texts):
            for a in range(0, len(text), piece):
                lead = min(a, self.order)
                sym = self.symbol[np.frombuffer(text, np.uint8, min(piece, len(text) - a) + lead, a - lead)]
                parts.extend([gap, sym])
                spans.append((i, size + 1 + lead, size + 1 + len(sym)))
                size += 1 + len(sym)
                if size >= piece:
                    flush()
        flush()
        return out


def learn(docs: DataFrame, per_language: int = 200, max_bytes: int = 65536, most_bytes: int = 64 << 20, order: int = 3) -> ContextTree:
    """Learns from a bounded sample: of each language, up to per_language distinct texts by hash order, those of up to max_bytes first.

    docs has doc_id, text and lang. Rows without lang or text are left out; so is what the caller has held out. Repeated texts
    count once, however many there are. The sample has most_bytes at the most, shared by the languages alike: each takes texts until
    its share is used; of a text that is longer than what a language may take from one (max_bytes, or its share), it learns that much
    from a place that the hash chooses. A label with over most_bytes / 1024 languages is an error.
    """
    rows = docs.filter("lang is not null and text is not null and length(text) > 0").select("lang", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
    kinds = stage(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "langid-kinds")
    languages = kinds.count()
    if languages > most_bytes >> 10:
        raise ValueError(f"{languages} languages are too many for a sample of {most_bytes} bytes")
    share = most_bytes // max(1, languages)
    longest = min(max_bytes, share)
    # about 8 times as many texts as are needed pass by their hash, so that copies and most texts never leave their task
    near = kinds.select("lang", (F.lit(8.0 * per_language) / F.col("n")).alias("part"))
    close = rows.select("lang", "size", "h").join(near, "lang").filter((F.pmod("h", F.lit(1 << 30)) < F.col("part") * F.lit(1 << 30)) | (F.col("part") >= 1)).select("lang", "size", "h").distinct()
    pick = Window.partitionBy("lang").orderBy((F.col("size") > longest).asc(), F.col("h").asc())
    few = close.withColumn("r", F.row_number().over(pick)).filter(F.col("r") <= per_language)
    used = F.sum(F.least("size", F.lit(longest))).over(pick.rowsBetween(Window.unboundedPreceding, 0))
    chosen = stage(few.withColumn("used", used).filter((F.col("used") <= share) | (F.col("r") == 1)).select("lang", "h"), "langid-sample")
    # at most per_language rows a language
    few = F.broadcast(chosen) if chosen.count() <= 100_000 else chosen
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.col("size") - longest + 1)) + 1
    part = F.substring(F.col("text").cast("binary"), begin.cast("int"), F.lit(longest)).alias("text")
    sample = rows.join(few, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", part).collect()
    release(chosen, kinds)
    texts: dict[str, list[bytes]] = {}
    for lang, text in sorted((r.lang, bytes(r.text)) for r in sample):
        texts.setdefault(lang, []).append(text)
    return ContextTree(texts, order)


def predict(docs: DataFrame, tree: ContextTree) -> DataFrame:
    """doc_id, lang_pred, score (the language's share of 2 ** -bits over all languages). Only the text is an input.

    Null text or none with a letter: und, score 0; so too if nothing was learned. Ties go to the first language by code point.
    Repeated rows stay, other columns are left out, an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def rows(cols: dict[str, list]) -> dict[str, list]:
        tree, texts = shared.value, cols["text"]
        out = [("und", 0.0)] * len(texts)
        use = [i for i, t in enumerate(texts) if t and tree.languages and _LETTER.search(t.decode())]
        bits = tree.score([texts[i] for i in use])
        best = bits.argmin(axis=1) if use else []
        for i, b, k in zip(use, bits, best):
            out[i] = (tree.languages[k], float(1 / np.exp2(np.maximum(b[k] - b, -1000)).sum()))
        return {"doc_id": cols["doc_id"], "lang_pred": [x[0] for x in out], "score": [x[1] for x in out]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), rows, f"doc_id {kind}, lang_pred string, score double", binary=("text",))


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tree = learn(docs.filter(~held_out()))
    return predict(docs, tree).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
