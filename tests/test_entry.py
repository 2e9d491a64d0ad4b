import random

import pytest

import __spark_entry__ as spark_entry
from ledgerline.operators import lineage


def test_entry_gives_rows(spark):
    rows = spark_entry.entry(spark)
    assert rows.count() == len(rows.collect()) > 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 255])
def test_stripes_count_the_edges_before(spark, n):
    rng = random.Random(n)
    edges = sorted(rng.sample(range(1000), n))
    at = [(k,) for k in [None, -1, 1001, *edges, *(rng.randrange(1000) for _ in range(50))]]
    rows = spark.createDataFrame(at, "at long")
    got = rows.select("at", lineage._stripe(rows["at"], edges, 0).alias("s")).collect()
    assert [(r.at, r.s) for r in got] == [(a, sum(e <= a for e in edges) if a is not None else 0) for (a,) in at]
