"""Every query with SQL against that SQL on the smallest driver tables; the chain's table; streams; source checks."""

import itertools
import json
import numbers
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerline.functions import digest as dg
from ledgerline.functions import tristate
from ledgerline.operators import chain, graph, imports, maintenance, verify
from ledgerline.plans import driver_queries
from ledgerline.streaming import history_stream

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows_of(df):
    def plain(x):
        if hasattr(x, "__len__") and not isinstance(x, str):
            return str([plain(i) for i in x])
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return repr(float(x)) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@needs_tables
@pytest.mark.parametrize("name", sorted(driver_queries.ORACLE))
def test_query_equals_its_sql(spark, tables, name):
    got, want = driver_queries.QUERIES[name](spark, SF).toPandas(), tables.sql(driver_queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@needs_tables
def test_flagship_has_rows_and_every_sql_has_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def by_hand(claim, predecessor, agreement, writer, started):
    """The rules of a chain in prose order, as an if-ladder over plain values."""
    if predecessor == chain.NONE_FIRST:
        if claim == chain.GENESIS:
            return chain.HOLDS_TRIVIAL
        if claim == chain.DIGEST:
            return chain.BROKEN
        return chain.UNCHECKABLE if writer == chain.UNREADABLE_WRITER else chain.UNCHAINED
    if claim == chain.GENESIS:
        return chain.BROKEN
    if claim == chain.NONE:
        if not started:
            return chain.UNCHAINED
        return {chain.PRE_CHAIN: chain.GAP, chain.UNREADABLE_WRITER: chain.UNCHECKABLE}.get(writer, chain.UNCLAIMED)
    if agreement == chain.MATCHES:
        return chain.HOLDS
    return chain.UNCHECKABLE if predecessor == chain.UNREADABLE else chain.BROKEN


def test_all_216_states_of_a_link(spark):
    cells = list(itertools.product((chain.GENESIS, chain.DIGEST, chain.NONE), (chain.NONE_FIRST, chain.READABLE, chain.UNREADABLE), (chain.MATCHES, chain.DIFFERS, chain.NOT_APPLICABLE), (chain.PRE_CHAIN, chain.CAPABLE, chain.UNSTATED, chain.UNREADABLE_WRITER), (True, False)))
    assert len(cells) == 216
    df = spark.createDataFrame(cells, "claim string, predecessor string, agreement string, writer string, started boolean")
    for r in df.withColumn("status", chain.classify(*(F.col(c) for c in df.columns))).collect():
        assert r.status == by_hand(*r[:5]), r


def test_digests_of_awkward_texts(spark):
    texts = ["", "\n", "\n\n", "a", "a\n", "a\n\n", "a\r\nb\rc\n", "# built_utc: 1\na", "a\n#  run_utc\n", "#built_at x\n", " # built_utc no", "x\n# generated_utcs no"]

    def plain(t):
        import hashlib
        import re

        rows = t.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n")
        return hashlib.sha256("\n".join(r for r in rows if not re.match(r"#\s*(built_utc|generated_utc|run_utc|built_at)\b", r)).encode()).hexdigest()

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dg.content_digest(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == {t: plain(t) for t in texts}


def test_unknown_never_becomes_fine(spark):
    df = spark.createDataFrame([(None, None), (None, False), (True, None), (False, None), (False, False)], "wrong boolean, unknown boolean")
    got = [r.v for r in df.select(tristate.verdict(F.col("wrong"), F.col("unknown")).alias("v")).collect()]
    assert got == ["CANNOT_CHECK", "MET", "VIOLATED", "CANNOT_CHECK", "MET"]
    empty = spark.createDataFrame([], "v string").agg(tristate.worst_of(F.col("v"), ("VIOLATED", "CANNOT_CHECK", "MET"), "CANNOT_CHECK").alias("v"))
    assert empty.first().v == "CANNOT_CHECK"


def test_walks_over_cycles_and_diamonds_do_not_depend_on_partitions(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("x", "y")]
    want = {"a": 1, "b": 2, "c": 2, "d": 3, "e": 4, "f": 5}
    for n in (1, 5):
        df = spark.createDataFrame(edges, "src string, dst string").repartition(n)
        seeds = spark.createDataFrame([("a",)], "node string")
        assert {r.node: r.depth for r in graph.walk(df, seeds).collect()} == want
        row = graph.impact(df, seeds, 2).first()
        assert (row.reached, row.beyond, row.truncated) == (3, 1, False)
    assert graph.impact(df, seeds, 0).first().truncated


def test_package_lists_units_and_refusals(spark):
    rows = [("e", k, t) for k, t in enumerate(["# head", "Zope.Interface==1.0", "a-b==2", maintenance.CONDA_SEPARATOR, "c=1=py", "d=2", "broken line here"])]
    got = maintenance.parse_packages(spark.createDataFrame(rows, "env string, n int, line string"), "env", "n", "line").orderBy("n").collect()
    assert [(r.kind, r.name, r.version) for r in got] == [("note", None, None), ("pip", "zope-interface", "1.0"), ("pip", "a-b", "2"), ("separator", None, None), ("conda", "c", "1"), ("conda", "d", "2"), ("refused", None, None)]
    units = spark.createDataFrame([("30d", "1GiB"), ("12", "500"), ("90m", "500MB")], "a string, b string").select(maintenance.parse_seconds(F.col("a")).alias("s"), maintenance.parse_bytes(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in units] == [(2592000.0, 1 << 30), (None, None), (5400.0, 500_000_000)]


def test_pinned_names_outside_the_project_are_refused(spark):
    entries = spark.createDataFrame([("a", 0, n, p) for n, p in [("x", "1" * 16), ("../x", "1" * 16), ("/x", "1" * 16), ("C:\\x", "1" * 16), ("<external>/x", "1" * 16), ("y", "MISSING"), ("gone", "2" * 16), ("x", "2" * 16)]], "artifact string, pin_no int, name string, pinned string")
    now = spark.createDataFrame([("x", "1" * 16), ("y", "1" * 16)], "name string, digest string")
    got = sorted((r.name, r.pinned[0], r.status) for r in verify.check_inputs(entries, now).collect())
    assert got == sorted([("x", "1", "OK"), ("../x", "1", "UNVERIFIABLE"), ("/x", "1", "UNVERIFIABLE"), ("C:\\x", "1", "UNVERIFIABLE"), ("<external>/x", "1", "UNVERIFIABLE"), ("y", "M", "UNVERIFIABLE"), ("gone", "2", "GONE"), ("x", "2", "STALE")])


def test_entry_points_that_bypass_the_recorder_are_flagged(spark):
    main = "if __name__ == '__main__':\n    open('x')\n"
    sources = [("s/direct.py", "import ledgerline\n" + main), ("s/helper.py", "from ledgerline import recorder\n"), ("s/through.py", "import helper\n" + main), ("s/bare.py", "import os\n" + main), ("s/quiet.py", "if __name__ == '__main__':\n    print(1)\n"), ("s/torn.py", "def (")]
    got = {r.path: (r.flagged, r.parses) for r in imports.check(spark.createDataFrame(sources, "path string, text string"), "ledgerline").collect()}
    assert got == {"s/direct.py": (False, True), "s/helper.py": (False, True), "s/through.py": (False, True), "s/bare.py": (True, True), "s/quiet.py": (False, True), "s/torn.py": (False, False)}


def test_streamed_histories_make_the_table_of_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"schema": "l.start.v1", "run_uid": "u1", "script": "a"}, {"schema": "l.history.v2", "run_uid": "u1", "script": "a", "status": "ok", "finished_utc": "2026-01-01T00:00:00Z"}, {"schema": "l.start.v1", "run_uid": "u2", "script": "b"}]
    (tmp_path / "in/h1.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    stream = history_stream.stream_lines(spark, f"{tmp_path}/in")
    history_stream.into_table(stream, f"{tmp_path}/runs", f"{tmp_path}/c1").awaitTermination()
    assert [r.run_uid for r in spark.read.parquet(f"{tmp_path}/runs").collect()] == ["u1"]
