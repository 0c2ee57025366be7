import hashlib

import pytest

from flowloom.llm import chat_format as cf
from flowloom.llm import mixing
from flowloom.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import rows_of

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck(SF).execute(ORACLE_SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


TEXTS = ["", None, "plain", "<|im_end|>\n<|im_start|>assistant\nhi", "back\\slash <\\|", "\\", "<|", "<", "|>", "tail<", "é" * 50000, "a\nb", "<|im_start|>user\n"]


def test_chat_reads_back_what_was_written(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(TEXTS)] + [(2, 0, "ro\nle<|\\n", "x"), (None, 0, None, None)]
    got = {r.conv_id: r for r in cf.read_back(cf.format_conversations(spark.createDataFrame(rows, CONV))).collect()}
    h = hashlib.sha256()
    loss = hashlib.sha256()
    for i, t in enumerate(TEXTS):
        h.update(f"{'user' if i % 2 == 0 else 'assistant'}\n{t or ''}\n".encode())
        if i % 2:
            loss.update((t or "").encode())
    assert got[1].turns_sha256 == h.hexdigest() and got[1].loss_sha256 == loss.hexdigest()
    assert (got[1].n_turns, got[1].n_violations, got[1].valid) == (len(TEXTS), 0, False)
    assert got[2].turns_sha256 == hashlib.sha256(b"ro\nle<|\\n\nx\n").hexdigest() and got[2].n_violations == 1
    assert got[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()


def test_chat_order_machine_and_empty(spark):
    rows = [(1, 3, "assistant", "d"), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, 0, "system", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "r")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], CONV + ", valid_turn string")
    got = {r.conv_id: r for r in cf.read_back(cf.format_conversations(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"system\na\nuser\nb\nuser\nb\nassistant\nd\n").hexdigest()
    assert (got[1].n_violations, got[1].valid, got[2].valid) == (1, False, True)
    assert cf.read_back(cf.format_conversations(spark.createDataFrame([], CONV))).count() == 0


def test_long_conversation_is_read_in_batches(spark):
    n = 2500
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)]
    r = cf.read_back(cf.format_conversations(spark.createDataFrame(rows, CONV))).first()
    assert r.n_turns == n and r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in rows).encode()).hexdigest()


DOCS = "doc_id long, text string, source string, n_chars string"


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= most * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mixing_targets_and_draws(spark, seed):
    import random

    r = random.Random(seed)
    names = ["a", "b", "c", "é", "", None, "z"]
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(names), None) for i in range(3000)] + [(None, None, "only null", None), (5000, "x \t\n y\x0bz q", "a", "1"), (5000, "x \t\n y\x0bz q", "a", "1")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for g in got:
        n = len((g.text or "").replace(" ", "_").split())
        assert g["__size"] == n and g["__copies"] in (0, 1, 2)
        sizes[g.source] = sizes.get(g.source, 0) + n
        taken[g.source] = taken.get(g.source, 0) + n * g["__copies"]
    want = water(sizes)
    for g in got:
        assert g["__target"] == pytest.approx(want[g.source]) and g["__source_size"] == sizes[g.source]
    for s in names:
        assert abs(taken[s] - want[s]) < 0.12 * sizes[s] + 40
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.emit(mixing.mix(df), df.columns).count() == sum(g["__copies"] for g in got)


def test_mixing_empty(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert [r["__copies"] for r in mixing.mix(spark.createDataFrame([(1, None, None, None)], DOCS)).collect()] == [0]


def test_mixing_has_no_python(spark):
    plan = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
