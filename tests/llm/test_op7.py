import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing
from loomgraph.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import odd_documents, rows


def against_sql(spark_rows, sql, sf_dir, names):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = {r[0]: dict(zip(names, r, strict=True)) for r in con.sql(f"select {', '.join(names)} from ({sql})").fetchall()}
    assert spark_rows.keys() == want.keys()
    for i, w in want.items():
        for k, v in w.items():
            assert spark_rows[i][k] == (pytest.approx(v, abs=2e-9) if isinstance(v, float) else v), (i, k)


def test_query_equals_sql(spark, sf_dir):
    names = ["doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept"]
    against_sql(rows(QUERIES["op7_raking"](spark, sf_dir)), ORACLES["op7_raking"], sf_dir, names)


def test_marginals_meet_targets(spark):
    cells = [(s, l, t, (3 * i + 7 * j + 11 * k) % 13 + 1) for i, s in enumerate("abc") for j, l in enumerate("xy") for k, t in enumerate("pqr")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    want = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.2, "q": 0.2, "r": 0.6}}
    got = mixing.raked(df, {d: share(t) for d, t in want.items()}, 0.2 * sum(c[3] for c in cells), rounds=30, tolerance=1e-9).collect()
    total = 0.2 * sum(c[3] for c in cells)
    for d, t in want.items():
        for value, s in t.items():
            assert sum(r["tokens"] * r["factor"] for r in got if r[d] == value) / total == pytest.approx(s, rel=1e-6)
    again = mixing.marginals(spark.createDataFrame(got), {d: share(t) for d, t in want.items()}, total).collect()
    assert len(again) == 8 and all(abs(r["residual"]) < 1e-6 for r in again)


def test_sample_has_target_proportions(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'w w w w w' AS text", "CASE WHEN id % 3 = 0 THEN 'big' ELSE concat('s', id % 5) END AS source", "'en' AS lang")
    out = mixing.chances(docs).groupBy("source").agg({"kept": "count", "probability": "max"})
    kept = {r["source"]: r["count"] for r in mixing.chances(docs).filter("kept").groupBy("source").count().collect()}
    chance = {r["source"]: (r["count(kept)"], r["max(probability)"]) for r in out.collect()}
    for s, (n, p) in chance.items():
        assert kept[s] == pytest.approx(n * p, abs=4 * (n * p * (1 - p)) ** 0.5 + 1)


def test_a_rare_cell_does_not_thin_the_rest(spark):
    """Two documents of a rare source stay whole; of the others half stays, in target proportions."""
    source = "CASE WHEN id < 2 THEN 'rare' WHEN id % 10 < 7 THEN 'hot' ELSE 'warm' END"
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'w w w w w' AS text", f"{source} AS source", "if(id < 2, 'xx', 'en') AS lang")
    got = {r["source"]: r for r in mixing.chances(docs).groupBy("source").agg(F.count("*").alias("n"), F.avg("probability").alias("p")).collect()}
    assert got["rare"]["p"] == 1.0
    assert sum(r["n"] * r["p"] for r in got.values()) / 20_000 == pytest.approx(mixing.RETENTION, abs=1e-3)
    hot, warm = got["hot"], got["warm"]
    assert hot["n"] * hot["p"] / (warm["n"] * warm["p"]) == pytest.approx((hot["n"] / warm["n"]) ** mixing.POWER, rel=1e-3)
    assert mixing.mixed(docs).count() == pytest.approx(10_000, abs=300)


def test_one_odd_document_changes_little(spark):
    docs = spark.range(5_000).selectExpr("id AS doc_id", "repeat('w ', 5 + id % 50) AS text", "concat('s', id % 3) AS source", "if(id % 7 = 0, 'de', 'en') AS lang")
    odd = spark.createDataFrame([(-1, "w", "s9", "xx")], "doc_id long, text string, source string, lang string")
    before = {r["doc_id"] for r in mixing.chances(docs).filter("kept").collect()}
    after = {r["doc_id"] for r in mixing.chances(docs.union(odd)).filter("kept").collect()}
    assert -1 in after and len(before ^ after) < 0.01 * len(before)


def test_missed_targets_show(spark):
    cells = spark.createDataFrame([("a", 10), ("b", 90)], "source string, tokens long")
    half = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double")}
    got = mixing.raked(cells, half, 60.0)
    kept = {r["source"]: r["tokens"] * min(1.0, r["factor"]) for r in got.collect()}
    assert kept["a"] == 10 and kept["b"] == pytest.approx(50, rel=1e-4)
    missed = {r["value"]: r["residual"] for r in mixing.marginals(got, half, 60.0).collect()}
    assert missed["a"] == pytest.approx(-20 / 60) and missed["b"] == pytest.approx(20 / 60, rel=1e-3)


def test_repeated_ids_go_together(spark):
    docs = spark.createDataFrame([(i % 5, f"w {i}", "s", "en", "x") for i in range(40)] + [(None, None, None, None, None)] * 2, "doc_id long, text string, source string, lang string, probability string")
    kept = [r["doc_id"] for r in mixing.mixed(docs).collect()]
    assert all(kept.count(i) in (0, 8) for i in range(5)) and kept.count(None) in (0, 2)


def test_odd_rows(spark):
    table = odd_documents(spark, [(1, None)])
    got = mixing.chances(table)
    assert got.count() == 14 and all(0 <= r["probability"] <= 1 for r in got.collect())
    out = mixing.mixed(table)
    assert out.columns == table.columns and out.count() <= 14
    assert mixing.chances(table.limit(0)).count() == 0
