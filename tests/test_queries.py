import pytest

from parlance.plans import coverage, evaluation  # noqa: F401
from parlance.plans.queries import ORACLES, QUERIES
from tests.helpers import connect, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLES:
        want = connect(data).execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_packed_sequences_hold_whole_texts(spark, data):
    """All of each text up to the cutoff is packed, and longer ones are dropped, not cut."""
    got = QUERIES["packed_sequences"](spark, data).selectExpr("sum(width - padding) AS n").first()["n"]
    want = connect(data).execute("SELECT sum(length(text)) FILTER (WHERE length(text) <= 1024), max(length(text)) FROM conversations").fetchone()
    assert want[1] > 1024 and got == want[0]


def test_batches_hold_whole_texts(spark, data):
    got = QUERIES["pad_batch"](spark, data).selectExpr("sum(width - padding) AS n").first()["n"]
    assert got == connect(data).execute("SELECT sum(length(text)) FROM documents").fetchone()[0]


def test_mixes_take_all_documents(spark, data):
    n = connect(data).execute("SELECT count(*) FROM documents").fetchone()[0]
    for name in ("mix_concat", "mix_rr_once", "mix_rr_over"):
        assert QUERIES[name](spark, data).select("doc_id").distinct().count() == n
    drawn = QUERIES["mix_probabilities"](spark, data)
    assert drawn.join(spark.read.parquet(f"{data}/documents.parquet").where("lang = 'en'"), "doc_id").count() > 0
