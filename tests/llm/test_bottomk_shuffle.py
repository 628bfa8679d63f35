"""What op13's plan shuffles and writes."""

from pyspark.sql import functions as F

from quadrille.llm import bottomk
from quadrille.llm.similarity import perhaps


def test_values_are_shuffled_once_and_whole_sets_not_written(spark, monkeypatch):
    written = {}

    def watched(df, name, *a, real=bottomk.materialize):
        written[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, *a)

    monkeypatch.setattr(bottomk, "materialize", watched)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda x: x + F.col("doc_id") % 7), " ")
    docs = spark.range(1, 30).select(F.col("id").alias("doc_id")).withColumn("text", F.concat(text, F.lit(" x"), F.col("doc_id") % 14))
    got = bottomk.near_duplicates(docs).collect()
    assert {r["component_id"] for r in got} <= set(range(1, 15)) and len(got) == 29
    assert written["bottomk-lists"].count("hashpartitioning(value") == 1
    assert "bottomk-whole" not in written


def test_rows_that_are_not_wanted_go_before_the_shuffle(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("sid"), F.col("id").alias("x"))
    wanted = rows.where("x % 100 = 0").select("sid")
    found = {r["x"] for r in perhaps(rows, wanted).collect()}
    assert found >= set(range(0, 20_000, 100)) and len(found) < 210
    assert perhaps(rows, wanted.limit(0)).count() == 0
