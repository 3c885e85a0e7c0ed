import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import media, metrics, rendering
from parlance.functions.tokens import Chars


def test_rouge_and_bleu():
    assert metrics.rouge("the cat sat", "the cat sat") == (100.0, 100.0, 100.0) and metrics.bleu4("abcdef", "abcdef") == 100.0
    assert metrics.rouge("", "x") == (0.0, 0.0, 0.0) and metrics.bleu4("xyz", "abc") == 0.0
    r1, r2, rl = metrics.rouge("the cat sat", "the cat ran away")
    assert (r1, r2, rl) == (57.1429, 40.0, 57.1429)
    assert metrics.segment("ab 你好c") == ["ab", "你", "好", "c"]
    assert 0 < metrics.bleu4("ab", "abcd") < 100


def test_classification(spark):
    rng = np.random.default_rng(3)
    p, y = rng.integers(0, 20, 300) / 20, rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    wins = sum((a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]) / ((y == 1).sum() * (y == 0).sum())
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(wins)
    best = max(((2 * ((p >= t) & (y == 1)).sum() / ((p >= t).sum() + y.sum()), -t) for t in set(p)))
    got = metrics.best_f1(df).first()
    assert got["f1"] == pytest.approx(best[0]) and got["threshold"] == -best[1]
    none = df.where("false")
    assert metrics.roc_auc(none).first()["auc"] is None and tuple(metrics.best_f1(none).first()) == (0.5, -1.0)
    c = {r["threshold"]: r for r in metrics.ratios(metrics.confusion(df, (0.5,))).collect()}[0.5]
    assert c["tp"] == ((p >= 0.5) & (y == 1)).sum() and c["tn"] == ((p < 0.5) & (y == 0)).sum()


def test_token_metrics(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [0, 1, -100, 3], [-1.0, -2.0, -3.0, 0.0]), ([1], [-100], [0.0])], "p array<int>, y array<int>, v array<double>")
    a, b = df.select(metrics.token_accuracy(F.col("p"), F.col("y")).alias("a"), metrics.masked_sum(F.col("v"), F.col("y")).alias("s")).collect()
    assert a["a"] == 1.0 and a["s"] == -4.0 and b["a"] is None
    s = df.select(metrics.split_sum(F.col("v"), F.col("y"), F.lit(1), 0.5).alias("s")).first()["s"]
    assert s == -1.0 + 0.5 * -3.0


def test_losses(spark):
    z, r = [1.0, 2.0, 0.5], [0.2, 0.1, 0.7]
    df = spark.createDataFrame([(z, r)], "z array<double>, r array<double>")
    p, q = np.exp(z) / np.exp(z).sum(), np.exp(r) / np.exp(r).sum()
    got = df.select(metrics.nll(F.col("z"), F.lit(1)).alias("n"), metrics.kl(F.col("z"), F.col("r")).alias("k"), metrics.top_entropy(F.col("z"), 3).alias("e")).first()
    assert got["n"] == pytest.approx(-math.log(p[1])) and got["k"] == pytest.approx((q * np.log(q / p)).sum()) and got["e"] == pytest.approx(-(p * np.log(p)).sum() / 3)
    o = spark.range(1).select(metrics.odds_ratio_loss(F.lit(-0.5), F.lit(-1.0), 0.1).alias("o")).first()["o"]
    odds = (-0.5 + 1.0) - (math.log1p(-math.exp(-0.5)) - math.log1p(-math.exp(-1.0)))
    assert o == pytest.approx(0.5 + 0.1 * math.log1p(math.exp(-odds)))


def test_generation_accounting(spark):
    df = spark.createDataFrame([([0, 0, 5, 6], [5, 6, 2, 0])], "q array<int>, r array<int>")
    g = df.select(metrics.trim_query(F.col("q"), 0).alias("q"), metrics.trim_response(F.col("r"), 0, 2).alias("r"), metrics.finished(F.col("r"), 2).alias("f")).first()
    assert g["q"] == [5, 6] and g["r"] == [5, 6, 2] and tuple(g["f"]) == (3, "stop")


def test_ema(spark):
    v = [3.0, 1.0, 2.0]
    w, last, want = 1.8 * (1 / (1 + math.exp(-0.15)) - 0.5), v[0], []
    for x in v:
        last = last * w + (1 - w) * x
        want.append(last)
    got = metrics.ema(spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "k int, i int, v double"), "v", "i", "k").orderBy("i").collect()
    assert [r["smoothed"] for r in got] == pytest.approx(want)


def test_flops(spark):
    cols = [F.lit(x) for x in (1, 2, 4, 10, 8, 2, 1, 1)]
    got = spark.range(1).select(metrics.model_flops(*cols, F.lit(False)).alias("x")).first()["x"]
    body = 2 * (6 * 4 * 8 + 4 * 16 + 2 * 16) + 4 * 4 * 4
    assert got == 3 * body + 3 * 2 * (2 * 4 * 10)


def test_media(spark):
    row = spark.range(1)
    frames = row.select(media.frame_indices(F.lit(100), F.lit(7)).alias("x")).first()["x"]
    assert frames == np.linspace(0, 99, 7).astype(np.int32).tolist()
    assert row.select(media.sampled_frames(F.lit(0), F.lit(9.0), 2.0, 16).alias("x")).first()["x"] == 16
    assert row.select(media.pixels(F.lit("768*768")).alias("x")).first()["x"] == 768 * 768
    assert row.select(media.pixtral_text(F.lit(32), F.lit(48), 16, "I", "B", "E").alias("x")).first()["x"] == "IIIBIIIE"
    assert row.select(media.audio_tokens_strided(F.lit(100)).alias("x")).first()["x"] == ((100 - 1) // 2 + 1 - 2) // 2 + 1
    texts = F.array(F.lit("1"), F.lit("2"))
    assert row.select(media.expand(F.lit("a<image>b<image>c<image>"), "<image>", texts).alias("x")).first()["x"] == "a1b2c<image>"
    h, w = media.smart_resize(F.lit(1000), F.lit(2000), 28, 4 * 28 * 28, 1280 * 28 * 28)
    got = row.select(h.alias("h"), w.alias("w")).first()
    assert got["h"] % 28 == 0 and got["w"] % 28 == 0 and got["h"] * got["w"] <= 1280 * 28 * 28


def test_rendering(spark):
    text = lambda v: [{"type": "text", "value": v}]
    talk = [{"role": "system", "content": text("s")}, {"role": "user", "content": text("q")}, {"role": "assistant", "content": [{"type": "reasoning", "value": "why"}, {"type": "tool_call", "value": '{"name": "f", "arguments": {"a": 1}}'}]}, {"role": "tool", "content": text("r1")}, {"role": "tool", "content": text("r2")}, {"role": "assistant", "content": text("done")}]
    parts = rendering.thinking_segments(talk)
    whole = "".join(p for p, _ in parts)
    assert "<think>\nwhy\n</think>\n\n<tool_call>\n" in whole and "<|im_start|>user\n<tool_response>\nr1\n</tool_response>\n<tool_response>\nr2\n</tool_response><|im_end|>\n" in whole
    assert whole.endswith("<|im_start|>assistant\n<think>\n\n</think>\n\ndone<|im_end|>\n") and [w for _, w in parts] == [0.0, 0.0, 1.0, 0.0, 0.0, 1.0]
    assert rendering.thinking_segments(talk[:2], '[{"name": "f"}]', generate=True)[0][0].startswith("<|im_start|>system\ns\n\n# Tools")
    assert rendering.parse_parts("<think>\na\n</think>\n\nb<tool_call>\n{}\n</tool_call>") == [{"type": "reasoning", "value": "a"}, {"type": "text", "value": "b"}, {"type": "tool_call", "value": "{}"}]
    with pytest.raises(ValueError):
        rendering.parse_parts("<tool_call>x</tool_call>")
    seg = spark.createDataFrame([([("ab", 0.0), ("c", 1.0)],)], f"s {rendering.SEGMENTS}")
    r = seg.select(rendering.segment_inputs(F.col("s"), Chars().encode).alias("x")).first()["x"]
    assert r["labels"][:2] == [-100, -100] and r["labels"][2] == r["input_ids"][2] and r["position_ids"] == [1, 2, 3]


def test_char_tokens(spark):
    df = spark.createDataFrame([("aé日👩",)], "t string")
    ids = df.select(Chars().encode(F.col("t")).alias("i")).first()["i"]
    assert ids == [ord(c) + 3 for c in "aé日👩"]
