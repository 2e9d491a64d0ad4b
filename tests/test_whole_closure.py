"""import_closure_whole against a walk in plain Python over all rows."""

from collections import defaultdict

from ledgerline.plans import driver_queries


def test_closure_reaches_the_fixed_point_over_all_rows(spark, tmp_path):
    chain = [(2 * k, 1 + k, k) for k in range(6)] + [(2 * k + 1, 2 + k, k) for k in range(6)]  # s1 > p0 > s2 > p1 > ...
    rows = [*chain, (3, 1, 5), (101, 9, 500), (None, 5, 5), (7, None, 3), (8, 2, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = defaultdict(set)
    for order, s, p in rows:
        if s is not None and p is not None:
            a, b = (f"s{s}", f"p{p}") if order is not None and order % 2 == 0 else (f"p{p}", f"s{s}")
            out[a].add(b)
    want, now, depth = {"s1": 1}, ["s1"], 1
    while now:
        depth += 1
        now = [x for x in sorted({y for n in now for y in out[n]}) if x not in want]
        want |= dict.fromkeys(now, depth)
    got = driver_queries.QUERIES["import_closure_whole"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 13 and {r.node: r.depth for r in got} == want
