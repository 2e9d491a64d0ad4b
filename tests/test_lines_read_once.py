"""Questions over histories read each line once, whatever they ask of it, and odd lines are judged as before."""

import os
import re

import pytest

from ledgerline.operators import graph, views
from ledgerline.plans import driver_queries, history_queries  # noqa: F401 - registers its queries
from ledgerline.sources import history

SF = "/root/testdata/sf0.001"
#: Questions that go over the lines in one pass, and questions that store what they ask more than once.
ONCE = ("history_rules", "history_gate", "history_log", "history_scripts", "history_script_values", "history_writers", "history_io")
STORED = ("history_crate", "history_file_diff", "history_prov", "history_verify", "history_verify_report", "history_lineage", "history_in_flight", "history_markers", "history_resource_diff", "history_select", "history_inputs_verify", "history_find_match", "history_claims")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ONCE + STORED)
def test_lines_are_read_once(spark, monkeypatch, name):
    stored = lambda df, label="": spark.createDataFrame([], df.schema)  # noqa: E731 - in the plan no more is left of it
    monkeypatch.setattr(graph, "cut", stored)
    text = plan(driver_queries.QUERIES[name](spark, SF))
    assert text.count("_is_object(") == (name in ONCE)
    assert not re.search(r"Filter [^\n]*from_json", text)


def test_states_of_odd_lines(spark, tmp_path):
    ok = ['{"a": 1}', " {} ", "{}\r", '{"pid": 3, "zz": [{"b": {}}]}', '{"resources": {"wall_seconds": NaN}}', '{"zz": -Infinity}', '{"script": "a", "script": "b"}', '{"script": "a}b"}', '{"script": "x}\\"} y"}', '{"prev": 5}', '{"script": "é"}']
    bad = ["[]", "[{}]", "null", "{}{}", "{} x", "{'script': 'a'}", '{"zz": INF}', '{"pid": "x"}', '{"inputs": {}}', '{"script": "\t"}', '{"a": 01}', '{"script": "a"', "x{}", '{"parameters": {"a": 1, "a": 2}}']
    blank = ["  ", "\t\r", ""]
    (tmp_path / "h.jsonl").write_bytes("\n".join([*ok, *bad, *blank]).encode() + b"\n")
    got = [r.parse_state for r in history.parsed(history.lines(spark, str(tmp_path / "h.jsonl"))).orderBy("position").collect()]
    assert got == ["ok"] * len(ok) + ["bad"] * len(bad) + ["blank"] * len(blank)


@pytest.mark.parametrize("block", [1, 3, 1 << 17])
def test_next_values_by_blocks_are_those_of_one_walk(spark, block):
    rows = [("a", k, float(k) if k % 4 else None) for k in (0, 1, 2, 5, 6, 9, 40)] + [("b", 7, 1.0), (None, 1, 2.0), (None, 3, 4.0)]
    got = {(r.s, r.k): r.b for r in views.with_next(spark.createDataFrame(rows, "s string, k long, a double"), "s", "k", "a", "b", block).collect()}
    later = lambda s, k: next((a for t, n, a in sorted(rows, key=lambda r: r[1]) if t == s and n > k), None)
    assert got == {(s, k): later(s, k) for s, k, _ in rows}
