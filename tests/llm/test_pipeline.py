import collections
import math

import pytest

import corpus_pipeline
from parlance.llm import mixing, quality, queries, tiling
from tests.helpers import connect, rows
from tests.llm.test_operators import similar_model, slow_tiles


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialise(stage(spark, docs, data), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    got = out.select("shard", "slot").collect()
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_queries_with_sql(spark, data):
    con = connect(data)
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, data).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_stages_of_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, data), name)
    assert docs.count() == 0


def test_stages_of_odd_rows(spark, data):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    made = [(None, None, None, None, None, None, None), (1, "", "en", "a", 0, 1, "x"), (2, "word " * 40_000, "en", None, 9, 2, "y"), (3, "a b c d e f g", None, "a", None, None, None)]
    made += [made[3], made[3], (3, "another text of the same number", "en", "b", 1, 1, "z"), (4, "é   tie", "fr", "", 1, 1, "z")]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, uid string")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, data), name)
        got = out.collect()
        if name == "sharding":
            assert {"shard_doc", "shard", "slot"} <= set(out.columns) and len(got) == len(made)
        else:
            assert out.columns == docs.columns
        if name == "near_duplicates":
            texts = [r["text"] for r in got]
            assert texts.count("a b c d e f g") == 1 and len(got) == len(made) - 3  # one of the empty pair and two repeats go
        if name == "decontamination":
            assert len(got) == len(made)


def plain_tail(model, text):
    """P(best grade) of one text by a dictionary of weights."""
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    link = sum(weight.get(x, 0.0) for x in quality.features((text or "").encode()).tolist())
    return 1 - 1 / (1 + math.exp(-max(-35, min(35, model.thresholds[-1] - link))))


def test_quality_query_equals_plain_scoring(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.train(docs, labels)
    want = {r["doc_id"]: t for r in docs.collect() if (t := plain_tail(model, r["text"])) >= quality.KEEP_TAIL}
    got = {r["doc_id"]: r["tail_prob"] for r in queries.QUERIES["op4_ordinal_quality"](spark, data).collect()}
    assert got == pytest.approx(want) and 0 < len(want) < docs.count()
    held = labels.collect()
    agree = [((got.get(r["doc_id"], 0) > 0) == (r["quality"] == 1 and r["toxic"] == 0)) for r in held]
    assert sum(agree) / len(agree) > 0.9


def test_pipeline_equals_brute_force(spark, data):
    """Each stage's rows against a plain version over all of its input."""
    rows_of = lambda df: [tuple(r) for r in df.collect()]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    text, source, doc_id = (names.index(x) for x in ("text", "source", "doc_id"))
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        outs[name] = corpus_pipeline.materialise(stage(spark, docs if not outs else outs[last], data), name)
        last = name
    # Quality.
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    kept = rows_of(outs["quality"])
    assert sorted(kept, key=repr) == sorted((r for r in rows_of(docs) if plain_tail(model, r[text]) >= quality.KEEP_TAIL), key=repr)
    # Near-duplicates: one row of each group of all pairs' links.
    groups = similar_model([r[text] or "" for r in kept])
    left = rows_of(outs["near_duplicates"])
    assert len(left) == len(groups) and all(len(set(left) & {kept[i] for i in g}) == 1 for g in groups)
    # Decontamination.
    items = [tiling.words(r["text"] or "") for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]

    def dirty(r):
        words = tiling.words(r[text] or "")
        seeds = {tuple(words[i : i + tiling.MIN_MATCH]) for i in range(len(words))}
        near = [x for x in items if any(tuple(x[i : i + tiling.MIN_MATCH]) in seeds for i in range(len(x) - tiling.MIN_MATCH + 1))]
        return any(sum(n for _, _, n in slow_tiles(x, words, tiling.MIN_MATCH)) >= tiling.COVERAGE * len(x) for x in near)

    clean = rows_of(outs["decontamination"])
    assert sorted(clean, key=repr) == sorted((r for r in left if not dirty(r)), key=repr) and len(clean) < len(left)
    # Mixing: every source near its target, no row more than twice.
    mixed = collections.Counter(rows_of(outs["mixing"]))
    size = lambda r: len((r[text] or "").split())
    sizes = collections.Counter()
    for r in clean:
        sizes[r[source]] += size(r)
    want = mixing.targets(dict(sizes))
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    for s in sizes:
        taken = sum(n * size(r) for r, n in mixed.items() if r[source] == s)
        assert abs(taken - want[s]) <= max(size(r) for r in clean if r[source] == s)
    # Sharding: the same rows, gapless slots, loads near equal.
    placed = outs["sharding"].collect()
    assert collections.Counter(tuple(r[c] for c in names) for r in placed) == mixed
    loads, slots = collections.Counter(), collections.defaultdict(list)
    for r in placed:
        loads[r["shard"]] += len((r["text"] or "").encode()) + 16
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 16
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(loads.values()) - min(loads[i] for i in range(40)) <= 2 * max(r["size"] for r in placed) + 0.02 * sum(loads.values()) / 40
