"""The streaming feedback job equals its batch twin."""

from tests.conftest import SF0001


def test_stream_equals_batch_twin(spark):
    import __spark_entry__ as E
    from tools.oracle_check import rows_of
    q = E.queries()
    a = q["feedback_stream"](spark, SF0001).toPandas()
    b = q["feedback_latest"](spark, SF0001).toPandas()
    assert len(a) > 0 and rows_of(a) == rows_of(b)


