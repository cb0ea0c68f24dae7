"""Queries whose rows are costly spread them over every core, though the table is one small file."""

from runhealth.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_logs_json_queries_use_every_core(spark):
    for name in ("diagnose_json", "suggest_fix_json"):
        df = catalog.queries()[name](spark, SMALL)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name
