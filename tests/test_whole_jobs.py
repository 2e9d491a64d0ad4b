"""The unbounded forms of queries that have a bounded one."""

from ledgerline.plans import driver_queries


def test_walk_of_turns_has_no_depth_limit(spark, tmp_path):
    turns = [(1, t) for t in range(12)] + [(2, 3), (2, 4), (2, 4), (2, 6)]
    spark.createDataFrame(turns, "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.node: r.depth for r in driver_queries.QUERIES["impact_unlimited"](spark, str(tmp_path)).collect()}
    assert got == {f"1:{t}": t + 1 for t in range(12)} | {"2:3": 1, "2:4": 2}
