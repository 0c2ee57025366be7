import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowloom.llm import bpe
from flowloom.llm import range_coder as rc
from flowloom.llm import token_files as tf
from flowloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, ids string"
ALPHABET = "ab \n\t'sté1²·<|>\xa0　日\U0001f600́.,A-ÉΣİ"
ODD = ["", " ", "\n", "a  b", "a \n b", "<|endoftext|>", "x <|endoftext|>  y\n<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> Up", "  lead", "trail ", "trail\n", "it's we'll 'S don't", "a" * 300, "1234 ⅷ ²", "\x1c\x1d a\x85b", "a\tb\r\nc", "࢏ab ࢏ \U00010940", "ab" * 200 + " " + "".join(random.Random(1).choice("abcdefghij") for _ in range(800)), "É É é́ ẛ̣", "A.B.,C;D:E!F?", "...", "e.g. U.S.A., x,y"]


def texts(spark, n=150):
    r = random.Random(5)
    made = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(500)]
    return ODD + made + [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").limit(n).collect()]


def test_bpe_equals_the_library(spark):
    tok = Tokenizer.from_file(BYTE)
    tok.no_padding()
    tok.no_truncation()
    all_ = texts(spark)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(all_)] + [(-1, None, "x"), (0, "", "x")], DOCS)
    got = bpe.bpe_encode(df, BYTE).collect()
    assert len(got) == len(all_) + 2
    for g in got:
        t = all_[g.doc_id] if g.doc_id >= 0 else ""
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(g.ids, "<u4").tolist() == ids, t
        assert g.decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_encode(df.limit(0), BYTE).count() == 0


def test_op10_digests(spark):
    tok = Tokenizer.from_file(BYTE)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for g in QUERIES["op10_bpe"](spark, SF).collect():
        ids = tok.encode(docs[g.doc_id], add_special_tokens=False).ids
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[g.doc_id].encode()).hexdigest())


def test_long_words_merge_alike():
    v = bpe.Vocabulary(BYTE)
    r = random.Random(2)
    words = [bytes(r.choice(b"abcdeabc") for _ in range(r.randint(1, 64))) for _ in range(300)] + [b"a" * n for n in range(1, 60)]
    assert v.merge(words) == [v.merge_long(w).tobytes() for w in words]


def test_lexicon_is_minimal_and_exact(tmp_path):
    r = random.Random(3)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 7))).encode(): r.randbytes(4 * r.randint(1, 3)) for _ in range(300)}
    lex = bpe.Lexicon.build(words)
    lex.save(str(tmp_path / "l"))
    lex = bpe.Lexicon.load(str(tmp_path / "l"))
    probes = list(words) + [b"", b"abcabcabc", b"zzz", b"ab\xff"]
    assert lex.find(probes) == [words.get(p) for p in probes]
    # as many states as there are different sets of endings
    ends = {}
    for p in {w[:i] for w in words for i in range(len(w) + 1)}:
        ends[p] = frozenset(w[len(p) :] for w in words if w.startswith(p))
    assert len(lex.final) == len(set(ends.values()))
    assert bpe.Lexicon.build({}).find([b"a", b""]) == [None, None]


def test_frequent_words_counts_all(spark):
    df = spark.createDataFrame([("a b a c",), ("a b d",), (None,), ("e",)], "text string").repartition(3)
    assert bpe.frequent_words(df) == ["a", "b"]
    assert bpe.frequent_words(df, keep=1) == ["a"]
    assert bpe.frequent_words(df.limit(0)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535) | st.integers(0, 5), max_size=400), st.integers(1, 90))
def test_range_coder_round_trip(ids, block):
    ids = np.array(ids, np.uint16)
    blocks = rc.encode_ids(ids, block)
    assert len(blocks) == -(-len(ids) // block)
    assert (rc.decode_ids(blocks, len(ids), block) == ids).all()


def test_range_coder_many_blocks(monkeypatch):
    monkeypatch.setattr(rc, "LANES", 7)
    r = np.random.default_rng(0)
    for ids in (r.zipf(1.2, 9999) % 60000, np.full(9999, 65535), np.zeros(9999), r.integers(0, 65536, 9999), np.tile([1, 2, 3, 40000], 2500)):
        ids = ids.astype(np.uint16)
        blocks = rc.encode_ids(ids, 128)
        assert (rc.decode_ids(blocks, len(ids), 128) == ids).all()
    assert sum(map(len, blocks)) < len(ids)  # what repeats gets small
    with pytest.raises(ValueError):
        rc.encode_ids(np.array([65536]))


def test_range_coder_beats_order_0_and_zlib(spark):
    tok = Tokenizer.from_file(WORD)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    ids = np.array([i for e in tok.encode_batch([r.text or "" for r in docs], add_special_tokens=False) for i in [*e.ids, 2]], np.uint16)
    prior = rc.Prior(ids)
    blocks = rc.encode_ids(ids, rc.BLOCK, prior)
    assert (rc.decode_ids(blocks, len(ids), rc.BLOCK, rc.Prior.unpack(prior.pack())) == ids).all()
    bits = 8 * (sum(map(len, blocks)) + len(prior.pack())) / len(ids)
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    assert bits < -(share * np.log2(share)).sum() < 8 * len(zlib.compress(ids.tobytes(), 9)) / len(ids)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535) | st.integers(0, 5), max_size=300))
def test_priors_round_trip(ids):
    ids = np.array(ids, np.uint16)
    prior = rc.Prior(ids)
    again = rc.Prior.unpack(prior.pack())
    assert prior.share.sum() == 1 << 16 and (again.share == prior.share).all() and (prior.share[ids] > 0).all()
    assert (rc.decode_ids(rc.encode_ids(ids, 50, prior), len(ids), 50, again) == ids).all()
    assert rc.Prior(np.arange(1 << 16)).share.tolist() == [1] * (1 << 16)


def test_damage_is_found():
    data = tf.pack_chunk([3, None], [2, 3], np.array([1, 2, 3, 4, 5], "<u2"))
    docs, counts, ids = tf.unpack_chunk(data)
    assert docs == [3, None] and counts.tolist() == [2, 3] and ids.tolist() == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        tf.unpack_chunk(b"X" + data[1:])
    with pytest.raises(ValueError):
        tf.unpack_chunk(data[:-9] + bytes([data[-9] ^ 0x55]) + data[-8:])


def test_token_files_equal_the_library(spark, tmp_path):
    tok = Tokenizer.from_file(WORD)
    all_ = texts(spark)
    rows = [(i * 3, t, "x") for i, t in enumerate(all_)] + [(None, "null id", "x"), (-5, None, "x"), (0, "again", "x"), (0, "again", "x")]
    path = f"file://{tmp_path}/files"
    tf.write_token_files(spark.createDataFrame(rows, DOCS).repartition(5), path, WORD)
    got = sorted(tf.read_token_files(spark, path).collect(), key=lambda g: g.start)
    want = sorted(((d, tok.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [g.doc_id for g in got] == [d for d, _ in want]
    at = 0
    for g in got:
        ids = np.frombuffer(g.ids, "<u4").tolist()
        assert g.start == at and ids in [w for d, w in want if d == g.doc_id]
        at += len(ids)
    assert sorted(map(str, (np.frombuffer(g.ids, "<u4").tolist() for g in got))) == sorted(str(w) for _, w in want)
    empty = f"file://{tmp_path}/empty"
    tf.write_token_files(spark.createDataFrame([], DOCS), empty, WORD)
    assert tf.read_token_files(spark, empty).count() == 0


def test_words_are_looked_up_once_a_call(monkeypatch):
    class Words(tf._Words):
        asked = 0

        def __getitem__(self, word):
            Words.asked += 1
            return super().__getitem__(word)

    monkeypatch.setattr(tf, "worker_memo", lambda key, make, kept={}: kept.setdefault(key, Words(WORD)))  # noqa: B006
    tok, r = Tokenizer.from_file(WORD), random.Random(3)
    odd = ["it's", "l'été", "don't'", "abc$$$", "Été!?", "éa\u00b7b,", "a<|b", "<|EndOfText|>", "x<|endoftext|>.", "İİ,", "ﬁn", "日本,", "e\u0301.", "1,5%", "--", "ab--cd;", "\x1cq", "a\x85b", "a\u00a0b", "µª"]
    texts_ = [None, "", " \t\r\n\x0b\x0c", *odd, *(c.join(r.choices(odd + ["The", "the", "THE;"], k=300)) for c in (" ", "\n ", "\t", "\x0b", "\x0c") for _ in range(20))]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts_]
    assert [np.frombuffer(p, "<u2").tolist() for p in tf.tokenise(pa.array(texts_), WORD)] == want
    assert Words.asked < 300 and sum(len((t or "").split()) for t in texts_) > 30_000
    assert [np.frombuffer(p, "<u2").tolist() for p in tf.tokenise(pa.array(texts_).slice(10, 50), WORD)] == want[10:60]
    one = [b"".join(tf.tokenise(pa.array(["an apple"]), WORD, most)) for most in (1 << 20, 500, 0)]
    words = tf.worker_memo(("token files", WORD), None)
    assert one[0] == one[1] == one[2] and (len(words), words.size) == (0, 0)
    tf.tokenise(pa.array(["some more words"]), WORD)
    tf.tokenise(pa.array(["an apple"]), WORD, 500)
    assert set(words) == {b"an", b"apple"} and 0 < words.size <= 500
    assert tf.tokenise(pa.array([None, " "], pa.string()), WORD) == [b"", b""] and tf.tokenise(pa.array([], pa.string()), WORD) == []


def test_op8_digests(spark):
    tok, at = Tokenizer.from_file(WORD), 0
    got = {g.doc_id: g for g in QUERIES["op8_token_files"](spark, SF).collect()}
    for d, t in sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
