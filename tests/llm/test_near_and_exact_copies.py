import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowloom.llm import graph, simhash
from flowloom.llm import suffix_dedup as sd
from flowloom.llm.common import stage

DOCS = "doc_id long, text string, count string"


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉ") for _ in range(r.randint(1, 6)))
    base = [[word() for _ in range(r.randint(0, 400))] for _ in range(n // 3)]
    texts = [None, "", "  \n", "One two", "one TWO", "a b c", "a b c d"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(r.randint(0, 3)):
            c = list(b)
            if c:
                c[r.randrange(len(c))] = word()
            texts.append(r.choice([" ", "\n", "\t "]).join(c))
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_simhash_equals_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[9], "x")], DOCS)
    fps = [slow_fingerprint(t) for t in texts]
    assert fps == [simhash.fingerprint((t or "").encode()) for t in texts]
    roots = slow_components(fps)
    least = {}
    for i, c in enumerate(roots):
        least[c] = min(least.get(c, i), i)
    got = simhash.near_duplicates(df).collect()
    assert {(g.doc_id, g.fingerprint, g.component_id) for g in got} == {(i, f"{f:016x}", least[c]) for i, (f, c) in enumerate(zip(fps, roots))} | {(None, f"{fps[9]:016x}", least[roots[9]])}
    kept = simhash.one_of_each(df.unionByName(df.limit(5)))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}{i}" for i in range(3000)) + "\x0b" + "y" * 5000
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 700)
    assert simhash.fingerprint(text.encode()) == whole == slow_fingerprint(text)


@pytest.mark.parametrize("tile_rows", [8192, 16])
@pytest.mark.parametrize("n", [300, 1 << 26])
def test_links_lose_no_pair(spark, tile_rows, n):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = [0, (1 << 64) - 1, 15]
    for b in base.tolist():
        for _ in range(8):
            x = b
            for bit in r.integers(0, 64, r.integers(0, 4)):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    comps = graph.connected_components(simhash.links(df, 4, n, tile_rows))
    got = {c.node: c.root for c in comps.collect()}
    roots = slow_components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    groups = {}
    for f, c in zip(signed, roots):
        groups.setdefault(c, []).append(f)
    for g in groups.values():
        assert {got.get(f, f) for f in g} == {min(g)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(5, 5), (100, 101), (101, 100)], "u long, v long")
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert graph.connected_components(edges.limit(0)).count() == 0


def slow_removal(texts, width):
    n = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if n[t[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("width, hot", [(12, 20000), (12, 3), (31, 20000), (31, 2)])
def test_suffix_dedup_equals_brute_force(spark, width, hot):
    r = random.Random(width)
    make = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    base = [make("ab", r.randint(0, 60)) for _ in range(50)]
    passage = make("abcdé\0", 90)
    texts = [*base, *base[:5], "x" * 100, "ab" * 60, None, "", "\0" * 40, "a\0" * 30, "é" * 40]
    texts += [make("abcdefgh", r.randint(0, 40)) + passage[r.randint(0, 20) : r.randint(30, 90)] + make("abcdefgh", r.randint(0, 40)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {g.doc_id: (g.n_bytes, g.n_removed, len(g.spans), hashlib.sha256(bytes(g.kept)).hexdigest()) for g in sd.remove_repeats(df, width, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == slow_removal([(t or "").encode() for t in texts], width)


def test_suffix_dedup_pieces_levels_and_edges(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 64)
    r = random.Random(2)
    t = "".join(r.choice("abcdefghij") for _ in range(700))
    texts = [t + t[100:300], "q" + t[50:200], t[:30]]
    of, first, count, *_ = sd.anchor_runs([x.encode() for x in texts], 20)
    windows = sorted((int(d), int(f) + k) for d, f, c in zip(of, first, count) for k in range(int(c)))
    assert windows == [(i, p) for i, x in enumerate(texts) for p in range(len(x) - 19)]
    assert sd.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    family = sd.LevelFamily(12)
    for i in range(9):
        family.add([b"0123456789abcd"], np.array([2]), np.array([3]), np.array([i]))
    assert [len(x) for x in family.levels] == [8, 1]
    assert family.finish().hits.sum() == 27


def test_two_widths_in_one_pass_equal_brute_force(spark):
    r = random.Random(5)
    make = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    passages = [make("abcdé", n) for n in (14, 20, 25, 60)]
    texts = [make("abcdefghij", r.randint(0, 30)) + r.choice(passages)[r.randint(0, 3) :] + make("abcdefghij", r.randint(0, 30)) for _ in range(80)]
    texts += [*texts[:4], None, "", "z" * 70, "xy" * 9, passages[0], passages[1]]
    raw = [(t or "").encode() for t in texts]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], DOCS).repartition(3)
    for hot, batches in ((20000, 4), (3, 3)):
        got = {g.doc_id: (g.n_bytes, g.n_removed, len(g.spans), hashlib.sha256(bytes(g.kept)).hexdigest(), g.n_also) for g in sd.remove_repeats(df, 24, hot=hot, also=13, batches=batches).collect()}
        short = slow_removal(raw, 13)
        assert [got[i] for i in range(len(texts))] == [(*x, s[1]) for x, s in zip(slow_removal(raw, 24), short)]


def test_levels_merge_geometrically(spark):
    texts = [f"{i}:" + "abcdefghijklmnopqrstuvwxyz" + str(i) for i in range(64)]
    keyed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").withColumn("key", sd.text_key())
    runs = stage(sd.anchors(keyed.select("key", "text"), (20,)), "runs")
    classes = runs.groupBy("id", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "count", "offset", "size")).alias("one")).select("id", "g", "n", "one.*")
    rows = stage(sd._contexts(keyed.select("key", "text"), classes, (20,), 1), "contexts").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(8))).collect()
    family, sizes, batches = sd.SuffixFamily(spark, (20,), 3), [], {}
    for r in rows:
        batches.setdefault(r.part, []).append(r)
    schema = sd._ROW + ", batch int, part long"
    for b in sorted(batches):
        family.add(spark.createDataFrame([tuple(r) for r in batches[b]], schema), len(batches[b]))
        sizes.append([n for n, _ in family.levels])
        for n, level in family.levels:
            assert level.count() == n
            there = level.orderBy("shard", "pos").collect()
            for x, y in zip(there, there[1:]):  # a suffix array by suffix, and by prefix
                if x.shard == y.shard:
                    assert bytes(x.right).ljust(20, b"\0") <= bytes(y.right).ljust(20, b"\0")
    assert all(x[-1] < 2 * x[-2] for x in sizes if len(x) > 1) and max(map(len, sizes)) < len(batches) and sum(sizes[-1]) == len(rows)
    apart = {(h.id, x) for h in family.finish().collect() for x in range(h.x0, h.x1 + 1)}
    whole = sd.SuffixFamily(spark, (20,), 3)
    whole.add(spark.createDataFrame([tuple(r) for r in rows], schema), len(rows))
    assert apart == {(h.id, x) for h in whole.finish().collect() for x in range(h.x0, h.x1 + 1)} and apart


def test_texts_stay_texts(spark):
    texts = ["é" * 300 + "ab", "xé" * 10 + "é" * 290, None, "short"]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], DOCS + ", n_chars int")
    got = {r.doc_id: r for r in sd.without_repeats(df).collect()}
    assert sd.without_repeats(df).columns == df.columns
    assert got[2].text is None and got[3].text == "short" and got[0].text == "ab" and got[0].n_chars == 2


def test_columns_of_the_caller_keep_their_names(spark):
    from flowloom.llm import mixing

    rows = [(i, f"some words of text number {i} here", "s", "en", "a", 1, 2.5, True) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, __id string, __size int, __copies double, kept boolean")
    one = simhash.one_of_each(df.unionByName(df))
    assert one.columns == df.columns and sorted(map(tuple, one.collect())) == sorted(rows)
    mixed = mixing.emit(mixing.mix(df), df.columns)
    assert mixed.columns == df.columns and {tuple(r) for r in mixed.collect()} <= set(rows)
    windows = df.withColumns({"key": F.lit(1), "first": F.lit(2), "n_bytes": F.lit("x"), "__runs": F.lit(0)})
    assert sd.without_repeats(windows).columns == windows.columns and sd.without_repeats(windows).count() == 20
