import pytest
from pyspark.sql import functions as F

from shelfwise.llm import urls


def test_shares_are_those_of_the_other_half_of_hosts(spark):
    hosts = ["casino.one.com", "www.two.com", "casino.three.net", "a.three.net", "b.three.net", "c.three.net", "c.three.net"]
    rows = spark.createDataFrame([(f"http://{h}/", h, "/") for h in hosts], "url string, host string, path string")
    got = urls._features(rows).withColumn("half", F.pmod(F.xxhash64("host"), F.lit(2))).collect()
    assert len(got) == len(hosts)
    for r in got:
        for name in ("domain", "suffix"):
            others = [o["label"] for o in got if o[name] == r[name] and o["half"] != r["half"]]
            assert r[f"{name}_share"] == pytest.approx((sum(others) + 1) / (len(others) + 2))
    alone = {r["host"]: r["domain_share"] for r in got}
    assert alone["casino.one.com"] == alone["www.two.com"] == 0.5
