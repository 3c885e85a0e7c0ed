import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.operators import collate as B
from parlance.operators import encode as E
from parlance.sources.readers import with_order


@pytest.mark.parametrize("case,want", [((3000, 2000, 1000), (600, 400)), ((2000, 3000, 1000), (400, 600)), ((1000, 100, 1000), (900, 100)), ((100, 1000, 1000), (100, 900)), ((100, 500, 1000), (100, 500)), ((500, 100, 1000), (500, 100)), ((10, 10, 1000), (10, 10))])
def test_budget(spark, case, want):
    s, t = E.budget(F.lit(case[0]), F.lit(case[1]), case[2])
    assert tuple(spark.range(1).select(s, t).first()) == want


PAIRS = "p array<struct<source:array<int>,target:array<int>>>"


def model(pairs, cutoff, history, efficient, prompt, eos=2):
    """Plain-Python model of the encoder."""
    def cut(s, t, c):
        k = c if t * 2 < c else c - s if s * 2 < c else int(c * t / max(s + t, 1))
        k = min(k, t)
        return min(max(c - k, 0), s), k

    ids, labels, used = [], [], int(efficient)
    for i, (a, b) in enumerate(pairs[::-1] if history else pairs):
        if used >= cutoff:
            break
        s, t = cut(len(a), len(b), cutoff - used)
        a, b, used = a[:s], b[:t], used + s + t
        la = a if prompt else ([eos] + [-100] * (s - 1) if efficient and i and s else [-100] * s)
        lb = [-100] * t if history and i else b
        ids, labels = (a + b + ids, la + lb + labels) if history else (ids + a + b, labels + la + lb)
    return ids + [eos] * efficient, labels + [eos] * efficient


@pytest.mark.parametrize("history,efficient,prompt", [(False, False, False), (True, False, False), (False, True, False), (False, False, True), (True, True, False)])
@pytest.mark.parametrize("cutoff", [4, 9, 100])
def test_supervised(spark, history, efficient, prompt, cutoff):
    pairs = [([11, 12, 13], [21, 22]), ([31], [41, 42, 43]), ([51, 52], [61])]
    df = spark.createDataFrame([([{"source": a, "target": b} for a, b in pairs],)], PAIRS)
    r = df.select(E.supervised(F.col("p"), cutoff, prompt, history, efficient).alias("x")).first()["x"]
    assert (r["input_ids"], r["labels"]) == model(pairs, cutoff, history, efficient, prompt)
    assert len(r["input_ids"]) == len(r["labels"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_knapsacks(lengths):
    sacks = E.knapsacks(lengths, 50)
    assert sorted(i for s in sacks for i in s) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in s) <= 50 for s in sacks)


def test_knapsack_order():
    assert E.knapsacks([3, 5, 3, 8], 8) == [[3], [1, 2], [0]]
    with pytest.raises(ValueError):
        E.knapsacks([9], 8)


def test_pack(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4] * 5), (2, [6]), (3, [7] * 20)], "_ord bigint, input_ids array<int>").withColumn("labels", F.col("input_ids"))
    rows = sorted(E.pack(df, 8, neat=True).collect(), key=lambda r: r["sack"])
    assert rows[0]["input_ids"] == [4, 4, 4, 4, 4, 1, 2, 3, 0] and rows[0]["attention_mask"] == [1] * 5 + [2] * 3 + [0] and rows[0]["position_ids"] == [0, 1, 2, 3, 4, 0, 1, 2, 0]
    assert rows[0]["labels"][-1] == -100 and rows[0]["boundaries"] == [0, 5, 8, 9] and rows[1]["input_ids"] == [6] + [0] * 8
    assert E.pack(df, 8).first()["attention_mask"] == [1] * 9


def test_pretrain_blocks(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, [4, 5, 6, 7, 8, 9]), (3, [10]), (4, [11, 12])], "_ord bigint, ids array<int>")
    rows = {(r["batch_id"], r["block_id"]): r["input_ids"] for r in E.pretrain_blocks(df, "ids", 4, batch=4, bos=0).collect()}
    assert rows == {(0, 0): [0, 2, 3, 4], (0, 1): [0, 6, 7, 8]}


def test_pairs_and_feedback(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5], [6], None)], "p array<int>, c array<int>, r array<int>, k array<int>")
    x = df.select(E.pairwise(F.col("p"), F.col("c"), F.col("r"), 10).alias("x")).first()["x"]
    assert x["chosen_labels"] == [-100] * 3 + [4, 5] and x["rejected_input_ids"] == [1, 2, 3, 6]
    y = df.select(E.feedback(F.col("p"), F.col("c"), F.col("k"), 10).alias("x")).first()["x"]
    assert y["kl_input_ids"] is None and y["labels"] == [-100] * 3 + [4, 5]


def test_flags():
    assert E.packing_flags(None, True, 100, "sft") == (True, True, 99)
    assert E.packing_flags(None, False, 100, "pretrain") == (True, False, 100)
    assert E.packing_flags(False, False, 100, "sft")[2] == 100


def test_pad_to_multiple(spark):
    df = spark.createDataFrame([(0, [0, 1, 2, 3, 4, 5]), (1, [6, 7])], "_ord bigint, input_ids array<int>").withColumn("labels", F.col("input_ids")).withColumn("attention_mask", E.mask(F.col("input_ids")))
    rows = sorted(B.pad_batches(df, 2, 8).collect(), key=lambda r: r["_ord"])
    assert rows[1]["input_ids"] == [6, 7] + [0] * 6 and rows[1]["attention_mask"] == [1, 1] + [0] * 6 and rows[1]["labels"] == [6, 7] + [-100] * 6


def test_segments(spark):
    df = spark.createDataFrame([(0, [1, 1, 2, 2, 2, 0]), (1, [1, 2, 2, 3, 3, 3])], "_ord bigint, attention_mask array<int>").withColumn("batch_id", F.lit(0))
    indices, lengths = B.unpad_data(df)
    rows = sorted(lengths.collect(), key=lambda r: (r["_ord"], r["segment"]))
    assert [r["n"] for r in rows] == [2, 3, 1, 2, 3] and [r["cumulative"] for r in rows] == [2, 5, 6, 8, 11]
    assert sorted(r["index"] for r in indices.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]


def test_block_mask(spark):
    m = spark.createDataFrame([([1, 1, 2, 0],)], "s array<int>").select(B.block_mask(F.col("s"), 0.0, -1.0).alias("m")).first()["m"]
    assert m == [[0, -1, -1, -1], [0, 0, -1, -1], [-1, -1, 0, -1], [-1, -1, -1, -1]]


def test_micro_batches(spark):
    df = with_order(spark.range(0, 20, 1, 3))
    rows = B.micro_batches(df, 8, 4).collect()
    assert len(rows) == 16 and {r["step"] for r in rows} == {0, 1} and {r["micro"] for r in rows} == {0, 1}
    with pytest.raises(ValueError):
        B.micro_batches(df, 8, 3)


def test_order(spark):
    df = spark.range(0, 100, 1, 7).withColumn("k", (F.col("id") * 37) % 100)
    assert [r["k"] for r in with_order(df, ["k"]).orderBy("_ord").collect()] == list(range(100))
    assert with_order(df.where("false"), ["k"]).count() == 0
    assert sorted(r["_ord"] for r in with_order(df.union(df), ["k"]).collect()) == list(range(200))
