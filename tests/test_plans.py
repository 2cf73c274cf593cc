"""Physical-plan checks: the shapes we rely on at scale."""

from pyspark.sql import functions as F

from tests.conftest import SF0001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_uses_window_group_limit(spark):
    from shelfwise.operators.ranking import topk_per_key
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    p = df._jdf.queryExecution().optimizedPlan().toString()
    t = topk_per_key(df, "k", [F.col("v").desc()], 3)
    assert "WindowGroupLimit" in t._jdf.queryExecution().optimizedPlan().toString()
    assert p


def test_content_recommend_has_no_cartesian_or_row_udf(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    p = plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p
    assert "MapInArrow" in p or "PythonMapInArrow" in p


def test_soft_delete_filter_reaches_parquet_scan(spark, tmp_path):
    from shelfwise.sources import testdata
    from shelfwise.sources.catalog import live_books
    src = testdata.load(spark, SF0001)
    path = str(tmp_path / "books")
    src.books.write.parquet(path)
    p = plan(live_books(spark.read.parquet(path)).select("book_id"))
    assert "PushedFilters: [IsNotNull(is_deleted), Not(EqualTo(is_deleted,true))]" in p
    assert "ReadSchema: struct<book_id:bigint,is_deleted:boolean>" in p


def test_interaction_store_is_one_partial_final_aggregate(spark):
    from shelfwise.operators.interactions import interaction_store
    from shelfwise.sources import testdata
    from shelfwise.sources.catalog import load_interactions
    s = testdata.load(spark, SF0001)
    p = plan(interaction_store(load_interactions(s.ratings, s.reading_history, s.favorites)))
    assert p.count("HashAggregate") >= 2


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_scorer_runs_once(spark):
    import __spark_entry__ as E
    q = E.queries()
    content = _final_plan(q["content_recommend"](spark, SF0001))
    assert content.count("MapInArrow") == 1 and "SinglePartition" not in content
    hybrid = _final_plan(q["hybrid_recommend"](spark, SF0001))
    assert hybrid.count("MapInArrow") == 0            # the blended lists are kept: both scorers ran before, once
    assert "CartesianProduct" not in hybrid and "BroadcastNestedLoopJoin" not in hybrid
