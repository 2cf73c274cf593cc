"""Every registered query with an oracle equals DuckDB on the sf0.001 tables."""

import duckdb
import pytest

from tests.conftest import SF0001

FAST = ["load_books", "load_interactions", "interaction_store", "user_profiles", "content_recommend",
        "similar_items", "popularity_recommend", "hybrid_recommend", "hybrid_recommend_latent",
        "diversity_recommend", "tfidf", "feedback_latest", "buffer_trigger", "eval_ndcg", "temporal_split",
        "random_split", "fold_assign", "exclude_seen", "artifact_roundtrip", "sample_users", "content_encode_table",
        "feedback_stream_profiles", "feedback_stream_popularity", "normalize_text", "string_agg_distinct", "interaction_stats"]


@pytest.fixture(scope="module")
def duck():
    from shelfwise.sources.testdata import RAW_TABLES
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", FAST)
def test_matches_duckdb(spark, duck, key):
    import __spark_entry__ as E
    from tools.oracle_check import rows_of
    sp = E.queries()[key](spark, SF0001).toPandas()
    dd = duck.execute(E.oracle_sql()[key]).df()
    assert rows_of(sp) == rows_of(dd)


def test_hash_split_does_not_depend_on_session_time_zone(spark, duck):
    import __spark_entry__ as E
    from tools.oracle_check import rows_of
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        sp = E.queries()["fold_assign"](spark, SF0001).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert rows_of(sp) == rows_of(duck.execute(E.oracle_sql()["fold_assign"]).df())
