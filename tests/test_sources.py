import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.functions.templates import REGISTRY
from parlance.operators import mix
from parlance.sources import readers, sinks
from parlance.sources.catalog import SourceSpec
from parlance.streaming import flows


def test_formats(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "c.csv").write_text("x\n1\n2\n")
    (tmp_path / "t.txt").write_text("1\n2\n")
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("x", pa.int64())])) as out:
        out.write_batch(pa.record_batch([pa.array([1, 2])], ["x"]))
    for name in ("j", "l.jsonl", "c.csv", "t.txt", "a.arrow"):
        df = readers.read_files(spark, f"file://{tmp_path / name}")
        assert sorted(int(r[0]) for r in df.collect()) == [1, 2], name
    (tmp_path / "j" / "b.csv").write_text("x\n")
    with pytest.raises(ValueError):
        readers.read_files(spark, f"file://{tmp_path / 'j'}")
    assert readers.cloud_files(["s3://a/b.json", "gcs://c/d.txt", "gs://e/f.jsonl"]) == ["s3a://a/b.json", "gs://e/f.jsonl"]


def test_cache_and_append(spark, tmp_path):
    assert sinks.load_encoded(spark, str(tmp_path / "none")) is None
    sinks.save_encoded({"train": spark.range(3), "validation": spark.range(1)}, str(tmp_path / "c"))
    found = sinks.load_encoded(spark, str(tmp_path / "c"))
    assert {k: d.count() for k, d in found.items()} == {"train": 3, "validation": 1}
    for _ in range(2):
        sinks.append_results(spark.range(2), str(tmp_path / "r"), "a")
    sinks.append_results(spark.range(5), str(tmp_path / "r"), "b")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 7


def test_restore_and_logs(spark):
    df = spark.createDataFrame([([0, 0, 5, -100],)], "i array<int>").select(sinks.restore(F.col("i"), 0).alias("i"))
    assert df.first()["i"] == [5, 0, 0, 0]
    assert sinks.log_lines(spark.createDataFrame([(1, None)], "a int, b int")).first()["value"] == '{"a":1}'


def test_stream_renders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"instruction": "q", "input": "", "output": "a"}\n{"instruction": "q2", "input": "", "output": null}\n')
    raw = flows.stream_files(spark, str(tmp_path / "in"), "jsonl", "instruction string, input string, output string")
    out = flows.stream_rendered(raw, SourceSpec("s"), REGISTRY["chatml"])
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).collect()[0]["response"] == "a<|im_end|>\n"
    q = flows.each_batch(flows.stream_files(spark, str(tmp_path / "in"), "jsonl", "instruction string"), lambda d: d.where("_ord = 0"), str(tmp_path / "b"), str(tmp_path / "cb"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1
    with pytest.raises(ValueError):
        flows.check_streaming(0, 0, None)


def test_mixing(spark):
    mk = lambda n, name: spark.range(n).select(F.lit(name).alias("s"), F.col("id").alias("_ord"))
    a, b = mk(3, "a"), mk(5, "b")
    order = lambda df: "".join(r["s"] for r in df.orderBy("_ord").collect())
    assert order(mix.mix([a, b], "interleave_under")) == "ababab"
    assert order(mix.mix([a, b], "interleave_over")) == "ababababab"
    assert order(mix.mix([a, b], "interleave_once")) == "abababbb"
    assert order(mix.mix([a, b])) == "aaabbbbb" and mix.mix([a], "interleave_under") is a
    weighted = mix.mix([mk(50, "a"), mk(500, "b")], "interleave_under", [0.5, 0.5], 1)
    assert sorted(r["_ord"] for r in weighted.collect()) == list(range(weighted.count()))
    with pytest.raises(ValueError):
        mix.mix([a, b], "concat", [0.5, 0.5])


def test_split_and_select(spark):
    df = spark.range(50).withColumnRenamed("id", "_ord")
    train, held = mix.holdout(df, 0.1, 1)
    assert (train.count(), held.count()) == (45, 5) and train.join(held, "_ord").count() == 0
    assert mix.holdout(df, 7, 1)[1].count() == 7
    for s in (slice(3, 20, 4), slice(-5, None), slice(None, None, -7), slice(30, 10, -3)):
        got = [r["_ord"] for r in mix.select_slice(df.withColumn("v", F.col("_ord")), s.start, s.stop, s.step).orderBy("_ord").select(F.col("v").alias("_ord")).collect()]
        assert got == list(range(50))[s]
    assert [r["v"] for r in mix.select_rows(df.withColumn("v", F.col("_ord")), [3, -1, 3]).orderBy("_ord").collect()] == [3, 49, 3]
    e = mix.epoch_order(df, 1, 0, 4)
    assert e.count() == 48 and e.groupBy("rank").count().where("count <> 12").count() == 0
    with pytest.raises(ValueError):
        mix.split(df, df, 0.1, 1)


def test_merge_pending_balance(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 1, 2), ("a", 2, 3)], "k string, o int, v int")
    assert sorted(tuple(r) for r in mix.merge_last(df, "k", "o").collect()) == [("a", 0, 3), ("b", 1, 2)]
    assert [r["k"] for r in mix.pending(df.select("k").distinct(), [df.where("k = 'a'")], "k").collect()] == ["b"]
    tasks = spark.createDataFrame([(i, x, i) for i, x in enumerate((5, 9, 3, 3))], "id int, load bigint, _ord bigint")
    assert {r["id"]: r["worker"] for r in mix.balance(tasks, 2).collect()} == {1: 0, 0: 1, 2: 1, 3: 1}
    stems = spark.createDataFrame([("a/b.c.mp4",), (".hidden",), ("x/y",)], "p string").select(mix.stem(F.col("p")).alias("s")).collect()
    assert [r["s"] for r in stems] == ["b.c", ".hidden", "y"]


def test_manifests_and_mappings(spark, tmp_path):
    df = spark.createDataFrame([([{"content": [{"type": "text", "video": None}, {"type": "video", "video": "v.mp4"}]}],), ([{"content": []}],)], "messages array<struct<content:array<struct<type:string,video:string>>>>")
    assert [r["v"] for r in df.select(readers.first_video().alias("v")).collect()] == ["v.mp4", None]
    (tmp_path / "mapping.json").write_text(json.dumps({"law": {"name": "Law", "category": "Social"}, "maths": {"name": "Maths", "category": "STEM"}}))
    got = readers.subjects(readers.read_files(spark, f"file://{tmp_path / 'mapping.json'}"))
    assert sorted(tuple(r) for r in got.collect()) == [("law", "Law", "Social"), ("maths", "Maths", "STEM")]
    ordered = readers.with_order(spark.range(7))
    assert [r["id"] for r in readers.page(ordered, 1, 2).orderBy("_ord").collect()] == [2, 3]
    readers.register_script("demo", lambda spark, n=3: spark.range(n))
    assert readers.SCRIPTS["demo"](spark).count() == 3


def test_order_keeps_columns_of_its_own_kind_of_names(spark):
    """Columns named _row or _part are carried as they are; a seeded split takes as many rows as it should."""
    from parlance.operators import mix

    df = spark.range(300).select(F.col("id").alias("_row"), (F.col("id") * 7 % 300).alias("k"), F.lit("x").alias("_part")).repartition(3)
    got = readers.with_order(df, ["k"]).collect()
    assert all(r["_row"] * 7 % 300 == r["k"] == r["_ord"] and r["_part"] == "x" for r in got) and len(got) == 300
    train, held = mix.holdout(readers.with_order(spark.range(300).toDF("v"), ["v"]), 0.1, 5)
    a, b = {r["v"] for r in train.collect()}, {r["v"] for r in held.collect()}
    assert len(a) == 270 and len(b) == 30 and not a & b
