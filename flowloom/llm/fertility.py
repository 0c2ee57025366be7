"""Quality rules by tokeniser fertility: how well a public vocabulary covers a text, with bands per script.

Measured over a whole text's words: characters per token, the share of byte-fallback tokens, and the entropy of the tokens.
A text of a script's characters that needs too many tokens or bytes, or repeats few tokens, is not prose of that script.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import map_rows, stage, table, worker_memo
from flowloom.llm.simhash import space_pieces

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, and most byte-fallback tokens, of any text of a script.

    thin_chars and thin_entropy hold for languages with too few texts for a band of their own: least characters per token, and
    least token entropy of an endless text (bits), of which a text of n tokens may lack thin_slope / sqrt(n).
    """

    chars: tuple[float, float] = (1.2, 7.0)
    fallback: float = 0.05
    thin_chars: float = 0.0
    thin_entropy: float = 4.0
    thin_slope: float = 12.0


@dataclass(frozen=True)
class Bands:
    """by_script: outer bands by main script; other: of scripts without one of their own.

    Within them, each language (without one, script) has a band of its own, from all distinct texts that pass the base rule: the
    deviations of characters per token and of token entropy from the medians of the language's texts of like length, in robust
    standard deviations, may add up to -spread at least. Lengths under least_rows use the texts of the lengths beside them too,
    then of all lengths of the language; languages under least_rows have their script's fixed band (Band's thin_ limits).
    """

    by_script: dict[str, Band] = field(
        default_factory=lambda: {
            "latin": Band(thin_chars=1.6, thin_entropy=6.4),
            "greek": Band((0.6, 4.0), 0.3),
            "cyrillic": Band((1.0, 6.0), 0.2),
            "hebrew": Band((0.4, 4.0), 0.6),
            "arabic": Band((0.4, 4.0), 0.6),
            "cjk": Band((0.3, 2.5), 0.8),
            "hangul": Band((0.3, 2.5), 0.8),
        }
    )
    other: Band = Band((0.25, 7.0), 0.95)
    least_letters: float = 0.5  # of the characters in words: below, a text has no script
    spread: float = 5.5
    # least standard deviations of a text of n tokens, times sqrt(n): what chance alone makes of them
    chance_chars: float = 0.7
    chance_entropy: float = 1.5
    least_rows: int = 30


#: Scripts by the first byte of a character's UTF-8 form.
_SCRIPTS = ["latin", "greek", "cyrillic", "hebrew", "arabic", "cjk", "hangul", "other"]
_BY_BYTE = np.zeros((256, len(_SCRIPTS)), np.int64)
for _lo, _hi, _s in ((0x41, 0x5A, 0), (0x61, 0x7A, 0), (0xC3, 0xC9, 0), (0xCD, 0xCF, 1), (0xD0, 0xD4, 2), (0xD7, 0xD7, 3), (0xD8, 0xDB, 4), (0xE0, 0xE0, 7), (0xE1, 0xE1, 7), (0xE3, 0xE9, 5), (0xEA, 0xED, 6), (0xF0, 0xF4, 7)):
    _BY_BYTE[_lo : _hi + 1, _s] = 1


class Words(dict):
    """Word: number. New words are queued; tokenise() gives them their tokens. size: bytes of memory, about."""

    def __init__(self, model):
        super().__init__()
        self.model, self.queue = model, []
        self.fallback = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.queue.clear()
        self.size = 0
        self.flat, self.start, self.count, self.bytes_ = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.queue.append(word.decode())
        self.size += 2 * len(word) + 200
        return n

    def tokenise(self) -> None:
        if self.queue:
            ids = self.model.encode(self.queue, num_threads=1)
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for i in ids for x in i), np.int32, count.sum())
            ends = np.cumsum(count)
            per = np.add.reduceat(np.append(self.fallback[flat], False).astype(np.int64), ends - count) * (count > 0)
            self.start = np.concatenate([self.start, len(self.flat) + ends - count])
            self.flat = np.concatenate([self.flat, flat])
            self.count = np.concatenate([self.count, count])
            self.bytes_ = np.concatenate([self.bytes_, per])
            self.queue.clear()

    def tokens(self, idx: np.ndarray) -> np.ndarray:
        n = self.count[idx]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[idx] - ends + n, n) + np.arange(n.sum())]


def repeated_words(idx: np.ndarray, width: int = 3) -> int:
    """Positions within windows of `width` words that are found twice or more, first places included."""
    n = len(idx) - width + 1
    if n < 2:
        return 0
    _, local = np.unique(idx, return_inverse=True)
    base = int(local.max()) + 1
    key = local[: n].astype(np.int64)
    for k in range(1, width):
        if base**2 >= 1 << 62:
            raise OverflowError
        key = key * base + local[k : k + n]
        if k < width - 1 and base ** (k + 2) >= 1 << 62:  # renumber, so that the next product fits
            _, key = np.unique(key, return_inverse=True)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(idx) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    r"""\n-split lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, vocabulary: str, bands: Bands = Bands(), most_bytes: int = 96 << 20, with_text: bool = False) -> DataFrame:
    """Per document: the other columns of docs (and its text, if asked for), the base rule's numbers, and what the method measures:
    n_tokens, chars_per_token (null without words), fallback_share, token_entropy (bits), script, outer (outside its band), thin_outer (outside the fixed band of thin languages), digest (of the text).

    vocabulary: path of a sentencepiece model with byte fallback. most_bytes: of words whose tokens a worker keeps between batches.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "script", "outer", "thin_outer", "digest")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])  # the measures have these names
    keep = [c for c in docs.columns if with_text or c != "text"]

    def rows(cols: dict[str, list]) -> dict[str, list]:
        def make() -> Words:
            import sentencepiece

            return Words(sentencepiece.SentencePieceProcessor(model_file=vocabulary))

        words = worker_memo(("fertility", vocabulary), make)
        out: dict[str, list] = {k: [] for k in names}
        idxs = []
        if words.size > most_bytes:
            words.clear_all()
        for text in cols["text"]:
            idxs.append(np.concatenate([np.fromiter(map(words.__getitem__, w), np.int32, len(w)) for w in space_pieces(text or b"")] or [np.zeros(0, np.int32)]))
        words.tokenise()
        for text, idx in zip(cols["text"], idxs):
            text, n = text or b"", len(idx)
            by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            chars = len(text) - int(by_byte[0x80:0xC0].sum()) - int(by_byte[[ord(c) for c in _SPACES]].sum())
            repeat = repeated_words(idx)
            tokens = words.tokens(idx)
            total = len(tokens)
            counts = np.bincount(tokens, minlength=1) if total > 4000 else np.unique(tokens, return_counts=True)[1]
            p = counts[counts > 0] / max(1, total)
            fallback = int(words.bytes_[idx].sum()) / total if total else 0.0
            letters = by_byte @ _BY_BYTE
            script = _SCRIPTS[int(letters.argmax())] if chars and letters.sum() >= bands.least_letters * chars else "none"
            band, per = bands.by_script.get(script, bands.other), chars / total if total else None
            outer = per is not None and not (band.chars[0] <= per <= band.chars[1] and fallback <= band.fallback)
            entropy = float(-(p * np.log2(p)).sum()) + 0.0
            thin = per is not None and (per < band.thin_chars or entropy < band.thin_entropy - band.thin_slope / total**0.5)
            row = (n, chars, int(by_byte[[ord(c) for c in _SYMBOLS]].sum()), duplicate_lines(text), repeat, n < 50 or 100 * repeat > 50 * n, total, per, fallback, entropy, script, outer, thin, blake2b(text, digest_size=16).digest())
            for k, v in zip(names, row):
                out[k].append(v)
        return {k: cols[k] for k in keep} | out

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    schema = f"{kinds}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string, outer boolean, thin_outer boolean, digest binary"
    return map_rows(docs.select(*[c for c in docs.columns if c != "text"], "text"), rows, schema, binary=("text",), memo=True)


def _usual(grouped: DataFrame, least: int) -> DataFrame:
    """Per group and length of any row: mid and sd of each measure, rounded to 0.01, from exact quartiles of the base-passing texts.

    Copies count once. They come from the first with at least `least` texts: the group's texts of that length (level 0), with those of the lengths
    beside it (1), of all lengths (2); a group with none has no row. Beyond level 0 lengths are mixed: entropy grows with length
    as a - slope / sqrt(tokens) within a group, so it is taken with slope / sqrt(tokens) added; tokens_mid is the median length.
    """
    root = F.sqrt(F.greatest("n_tokens", F.lit(1)))
    rows = grouped.filter("not base_failed").select("group", "digest", "length", "n_tokens", "chars_per_token", "token_entropy", root.alias("root")).dropDuplicates(["group", "digest"])
    fitted = F.round(F.coalesce(-F.regr_slope("token_entropy", 1 / F.col("root")), F.lit(0.0)), 1)
    slopes = stage(rows.groupBy("group").agg(F.greatest(F.lit(0.0), F.least(F.lit(64.0), fitted)).alias("slope")), "fertility-slopes")
    pool = lambda level, at: F.struct(F.lit(level).alias("level"), at.cast("int").alias("at"))
    length, every = F.col("length"), F.lit(-1)
    pooled = rows.join(slopes, "group").withColumn("pool", F.explode(F.array(pool(0, length), pool(1, length - 1), pool(1, length), pool(1, length + 1), pool(2, every))))
    slope = F.when(F.col("pool.level") == 0, F.lit(0.0)).otherwise(F.col("slope"))
    pooled = pooled.select("group", "pool", "n_tokens", "chars_per_token", (F.col("token_entropy") + slope / F.col("root")).alias("token_entropy"), slope.alias("slope"))
    quartiles = [F.percentile(F.round(m, 2), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{m}_q") for m in ("chars_per_token", "token_entropy")]
    tokens = F.when(F.col("pool.level") == 0, F.lit(0.0)).otherwise(F.percentile(F.exp(F.round(F.log("n_tokens"), 1)), F.lit(0.5)))
    q = pooled.groupBy("group", "pool").agg(F.count(F.lit(1)).alias("n"), F.first("slope").alias("slope"), tokens.alias("tokens_mid"), *quartiles).filter(F.col("n") >= least)
    keys = grouped.select("group", "length").distinct().withColumn("pool", F.explode(F.array(pool(0, length), pool(1, length), pool(2, every))))
    best = keys.join(q, ["group", "pool"]).groupBy("group", "length").agg(F.min_by(F.struct("slope", "tokens_mid", "chars_per_token_q", "token_entropy_q"), F.col("pool.level")).alias("b"))
    mids = [F.col(f"b.{m}_q")[1].alias(f"{m}_mid") for m in ("chars_per_token", "token_entropy")]
    sds = [F.greatest((F.col(f"b.{m}_q")[2] - F.col(f"b.{m}_q")[0]) / 1.349, F.lit(0.01)).alias(f"{m}_sd") for m in ("chars_per_token", "token_entropy")]
    return best.select("group", "length", "b.slope", "b.tokens_mid", *mids, *sds)


def fertility_rules(docs: DataFrame, vocabulary: str, bands: Bands = Bands(), with_text: bool = False) -> DataFrame:
    """measure(), and kept: false if the base rule fails or the text is outside its outer or language's band.

    docs has doc_id, text and lang; other columns stay, but for those with names of what is measured or judged, which are left out.
    Repeated rows stay, an empty table gives none. Null or empty text: no words, so base_failed. Null lang: as a language of all such texts of its script. deviation is 0
    where the language has no band and the script's fixed one decides.
    """
    own = ("group", "length", "deviation", "kept", *[f"{m}_{x}" for m in ("chars_per_token", "token_entropy") for x in ("mid", "sd")], "tokens_mid", "slope")
    got = stage(measure(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]), vocabulary, bands, with_text=with_text), "fertility")
    grouped = got.withColumn("group", F.coalesce(F.col("lang"), F.col("script"))).withColumn("length", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    # a row per language and length; as a table of its own its size is known, so that Spark broadcasts it only if it is small
    usual = stage(_usual(grouped, bands.least_rows), "fertility-usual")
    joined = grouped.join(usual, ["group", "length"], "left")
    tokens = F.greatest("n_tokens", F.lit(1))
    # of mixed lengths, shorter texts scatter more
    wider = F.greatest(F.lit(1.0), F.sqrt(F.col("tokens_mid") / tokens))
    sd = lambda m, chance: F.greatest(F.col(f"{m}_sd") * wider, F.lit(chance) / F.sqrt(tokens))
    z = lambda m, value, chance: F.least(F.coalesce((value - F.col(f"{m}_mid")) / sd(m, chance), F.lit(0.0)), F.lit(2.0))
    deviation = z("chars_per_token", F.col("chars_per_token"), bands.chance_chars) + z("token_entropy", F.col("token_entropy") + F.col("slope") / F.sqrt(tokens), bands.chance_entropy)
    inside = F.when(F.col("token_entropy_mid").isNull(), ~F.col("thin_outer")).otherwise(F.col("deviation") >= -bands.spread)
    judged = joined.withColumn("deviation", deviation).withColumn("kept", ~F.col("base_failed") & ~F.col("outer") & inside)
    return judged.drop("group", "length", "thin_outer", "digest", *[c for c in usual.columns if c not in ("group", "length")])


def keep_good(docs: DataFrame, vocabulary: str, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that fertility_rules() keeps, with their columns."""
    renamed = docs.select(*[F.col(f"`{c}`").alias(c if c in ("text", "lang") else f"__{c}") for c in docs.columns])
    good = fertility_rules(renamed, vocabulary, bands, with_text=True).filter("kept")
    return good.select(*[F.col(f"`{c}`" if c in ("text", "lang") else f"`__{c}`").alias(c) for c in docs.columns])


def op9_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fertility_rules(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("lang", "outer")
