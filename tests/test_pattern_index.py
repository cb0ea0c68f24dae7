"""Patterns that differ only in a number are kept apart by the index, so a line meets few of them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from runhealth.operators.patterns import literal_of, pattern_index, tag_patterns


def test_numbered_patterns_each_have_a_gram_of_their_own(spark):
    rows = [(f"job-{n}", rf"job_{n}\b") for n in range(1000, 3000)] + [(f"check-{n}", f"(?i)CHECK JOB {n}$") for n in range(1000, 3000)]
    table = spark.createDataFrame(rows, "name string, pattern string")
    index = pattern_index(table.withColumn("literal", literal_of(F.col("pattern"))))
    assert index.count() == len(rows)
    assert index.groupBy("gram").count().agg(F.max("count")).first()[0] == 1

    lines = [(1, "Monitor job_1234"), (2, "please check job 2999"), (3, "job_12345 and job_2000"), (4, "check job 1000 now"), (5, "job_99")]
    got = tag_patterns(spark.createDataFrame(lines, "n long, message string"), table, ["n"])
    want = {n: sorted(name for name, p in rows if re.search(p.replace("(?i)", ""), text, re.I if p.startswith("(?i)") else 0))
            for n, text in lines}
    assert {r["n"]: r["tags"] for r in got.collect()} == want
    assert want[1] == ["job-1234"] and want[2] == ["check-2999"] and want[3] == ["job-2000"] and want[4] == [] and want[5] == []
