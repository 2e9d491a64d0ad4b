"""Questions about histories, over JSON lines made of the driver's orders and line items, with the SQL they are held against.

Each order is a run: a start line, and a completed line unless its key says that it is
still running. Its line items are the run's inputs (odd numbers) and outputs (even ones).
Some keys put damaged, foreign or blank lines between. The lines go through the same
reading as files do; the SQL answers from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import digest as dg
from ledgerline.functions import tristate
from ledgerline.operators import compare, exports, facts, graph, lineage, policy, reports, verify, views
from ledgerline.plans.driver_queries import _t, query
from ledgerline.sources import history

_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _lines(spark, sf_dir) -> DataFrame:
    """(file, position, raw): the histories, one for each fourth of the customers."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    items = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    orders = _t(spark, sf_dir, "orders").join(items, "o_orderkey", "left")
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    code = lambda e: F.sha2(F.concat_ws(":", text(e["l_partkey"]), text(e["l_suppkey"] % 3)).cast("binary"), 256)

    def side(name, odd):
        own = F.filter(F.coalesce("items", F.expr("cast(array() as array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint>>)")), lambda e: (e["l_linenumber"] % 2 == 1) == F.lit(odd))
        digested = F.transform(own, lambda e: F.struct(F.concat(F.lit(f"{name}/"), text(e["l_partkey"])).alias("path"), code(e).alias("sha256"), e["l_suppkey"].alias("size_bytes")))
        return F.transform(digested, lambda e: F.struct(e["path"], e["sha256"], F.when(e["size_bytes"] % 5 == 0, e["sha256"]).alias("content_sha256"), e["size_bytes"]))

    uid, started = F.concat(F.lit("r"), text(k)), F.date_format("o_orderdate", _UTC)
    script = F.concat(F.lit("job"), text(F.col("o_custkey") % 7), F.lit(".py"))
    prev = F.when(k % 4 == 0, F.lit("GENESIS")).when(k % 4 == 1, F.sha2(text(k).cast("binary"), 256))
    start = F.to_json(F.struct(prev.alias("prev"), F.lit("ledgerline.start.v1").alias("schema"), uid.alias("run_uid"), script.alias("script"), started.alias("started_utc"), k.alias("pid")))
    number = F.when(k % 4 == 2, F.lit(5))  # a claim that is no text claims nothing
    done = F.struct(
        number.alias("prev"), F.lit("ledgerline.history.v2").alias("schema"), uid.alias("run_uid"), script.alias("script"),
        F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed").alias("status"),
        started.alias("started_utc"), F.date_format(F.col("o_orderdate") + F.expr("interval 1 day"), _UTC).alias("finished_utc"),
        F.struct(F.col("o_orderpriority").alias("priority"), F.when(k % 2 == 0, k % 10).alias("seed")).alias("parameters"),
        F.when(k % 17 != 0, F.struct(F.element_at(F.array(F.lit("all"), F.lit("none"), F.lit("snapshot"), F.lit(None)), (k % 4 + 1).cast("int")).alias("packages_recorded"), F.when(k % 19 == 0, 1).alias("unregistered_watch_truncated"))).alias("observation"),
        F.when(k % 5 != 0, F.struct(F.concat(F.lit("0."), text(k % 12), F.lit(".1")).alias("version"))).alias("tool"),
        F.when(k % 3 != 0, F.struct((F.col("o_totalprice") / 100).alias("wall_seconds"), (k % 4096 * 1048576).alias("max_rss_bytes"))).alias("resources"),
        F.when(k % 7 != 0, F.concat(F.lit("c"), text(k))).alias("git_commit"), (k % 5 == 0).alias("git_tree_dirty"), F.when(k % 11 != 0, k % 3 != 0).alias("git_status_captured"),
        F.struct(F.when(k % 23 == 0, "no access").alias("error"), F.when(k % 8 != 0, k % 9).alias("n_packages")).alias("environment_snapshot"),
        side("in", True).alias("inputs"), side("out", False).alias("outputs"),
        F.when(k % 6 == 0, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)")).alias("unregistered_reads"),
    )
    odd = F.when(k % 50 == 7, "[1, 2]").when(k % 50 == 9, '{"prev": "GENESIS", "torn').when(k % 50 == 11, " ").when(k % 50 == 13, '{"a": 1}{"prev": "GENESIS", "b": 2}').when(k % 50 == 15, "null")
    made = orders.withColumns({f"line{n}": raw for n, raw in enumerate((start, F.when(k % 13 != 0, F.to_json(done)), odd))})  # below the generator, where code is compiled
    each = F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"line{n}").alias("raw")) for n in range(3)))
    rows = made.select(F.concat(F.lit("h"), text(F.col("o_custkey") % 4)).alias("file"), k.alias("block"), F.explode(each).alias("e")).filter("e.raw is not null")
    return rows.select("file", F.struct("block", F.col("e.n").cast("bigint").alias("row")).alias("position"), F.col("e.raw").alias("raw"))


def _parsed(spark, sf_dir):
    return history.parsed(_lines(spark, sf_dir))


def _runs(spark, sf_dir):
    return history.completed(history.records(_parsed(spark, sf_dir)))


def _kept_runs(spark, sf_dir, *columns):
    """Completed runs with their entries, stored, for questions that ask them more than once: lines are read once."""
    fields = ("path", "kind", "size_bytes", "sha256", "content_sha256", "sha256_tree")
    entries = lambda c: F.transform(c, lambda e: F.struct(*(e[f] for f in fields))).alias(c)
    return graph.cut(_runs(spark, sf_dir).select("address", "started_utc", "finished_utc", *columns, entries("inputs"), entries("outputs")), "runs")


def _kept_io(spark, sf_dir, *columns):
    """The entries of completed runs, stored; ``columns`` are those of history.io_entries."""
    return graph.cut(history.io_entries(_runs(spark, sf_dir)).select(*columns), "io")


def _in_flight(spark, sf_dir):
    recs = graph.cut(history.records(_parsed(spark, sf_dir)).select("file", "schema", "run_uid", "script", "started_utc", "provenance_path"), "records")
    return views.in_flight(history.starts(recs), history.completed(recs))


_BASE = """
with o as (select o_orderkey as k, 'h' || (o_custkey % 4) as file, 'r' || o_orderkey as uid, 'job' || (o_custkey % 7) || '.py' as script, o_orderkey % 13 = 0 as open, o_orderpriority as priority, o_totalprice as price,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as started, strftime(o_orderdate + interval 1 day, '%Y-%m-%dT%H:%M:%SZ') as finished, case o_orderstatus when 'F' then 'ok' when 'O' then 'failed' end as status from orders),
d as (select * from o where not open),
i as (select l_orderkey as k, 'r' || l_orderkey as uid, case when l_linenumber % 2 = 1 then 'input' else 'output' end as role, row_number() over (partition by l_orderkey, l_linenumber % 2 order by l_linenumber, l_partkey, l_suppkey) - 1 as pos,
  case when l_linenumber % 2 = 1 then 'in/' else 'out/' end || l_partkey as path, sha256(l_partkey || ':' || (l_suppkey % 3)) as sha, l_suppkey as size from lineitem where l_orderkey % 13 <> 0 and l_orderkey in (select k from o))
"""


@query(_BASE + """, l as (select file, 'ok' as parse_state from o union all select file, 'ok' from d union all select file, case k % 50 when 11 then 'blank' else 'bad' end from o where k % 50 in (7, 9, 11, 13, 15))
select file, parse_state, count(*) as n from l group by all""")  # fmt: skip
def history_states(spark, sf_dir):
    """How many lines of each history are records, blank or unreadable."""
    return _parsed(spark, sf_dir).groupBy("file", "parse_state").agg(F.count("*").alias("n"))


@query(_BASE + """select file, case k % 50 when 7 then '[1, 2]' when 9 then '{"prev": "GENESIS", "torn' when 13 then '{"a": 1}{"prev": "GENESIS", "b": 2}' else 'null' end as raw, k from o where k % 50 in (7, 9, 13, 15) order by file, k limit 200""")
def history_unreadable(spark, sf_dir):
    """The first 200 unreadable lines, in order: so many are shown by definition."""
    return history.unreadable(_parsed(spark, sf_dir)).select("file", "raw", F.col("position.block").alias("k"))


@query(_BASE + "select script, count(*) as starts, count(*) filter (not open) as completed, min(k) as first_pid from o group by script")
def history_starts(spark, sf_dir):
    """Start lines and completed lines of each script."""
    recs = history.records(_parsed(spark, sf_dir))
    return recs.groupBy("script").agg(F.count_if(history.is_start()).alias("starts"), F.count_if(~history.is_start()).alias("completed"), F.min("pid").alias("first_pid"))


@query(_BASE + "select uid, file, started from o where open")
def history_in_flight(spark, sf_dir):
    """Runs that began and have not ended."""
    return _in_flight(spark, sf_dir).select(F.col("run_uid").alias("uid"), "file", F.col("started_utc").alias("started"))


@query(_BASE + """select coalesce(a.uid, m.uid) as uid, a.uid is not null as in_history, m.uid is not null as marked, m.host from (select uid from o where open) a
full join (select 'r' || o_orderkey as uid, 'host' || (o_orderkey % 3) as host from orders where o_orderkey % 26 = 0 union all select 'm' || o_orderkey, 'host9' from orders where o_orderkey % 200 = 1) m on a.uid = m.uid""")
def history_markers(spark, sf_dir):
    """Open runs beside their markers, and markers of which the history knows no start."""
    open_runs = _in_flight(spark, sf_dir).select("run_uid")
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    orders = _t(spark, sf_dir, "orders", "o_orderkey")
    known = orders.filter(k % 26 == 0).select(F.concat(F.lit("r"), text).alias("run_uid"), F.concat(F.lit("host"), (k % 3).cast("string")).alias("host"))
    marks = known.unionAll(orders.filter(k % 200 == 1).select(F.concat(F.lit("m"), text), F.lit("host9")))
    return views.with_markers(open_runs, marks).select(F.col("run_uid").alias("uid"), "in_history", "marked", F.col("marker_host").alias("host"))


@query(_BASE + "select uid as address, role, pos, path, size, sha as sha256, [sha] as digests from i")
def history_io(spark, sf_dir):
    """Every input and output of every completed run, with its digests."""
    return history.io_entries(_runs(spark, sf_dir)).select("address", "role", F.col("pos").cast("bigint").alias("pos"), "path", "size", "sha256", "digests")


_MATCHED = ", p as (select i.uid, i.sha, d.finished as tm from i join d using (k) where role = 'output' group by all), c as (select i.uid, i.pos, i.sha, d.started as tm from i join d using (k) where role = 'input'), r as (select c.uid as dst, c.pos, arg_max(p.uid, (p.tm, p.uid)) filter (where p.tm <= c.tm) as src, count(p.uid) as n from c left join p on p.sha = c.sha and p.uid <> c.uid group by c.uid, c.pos), classed as (select dst, pos, src, case when src is not null then 'resolvable' when n > 0 then 'unsequenced' else 'orphan' end as class from r)"


def _lineage(spark, sf_dir):
    return lineage.resolve(*history.lineage_sides(_kept_io(spark, sf_dir, "address", "role", "pos", "digests", "started_utc", "produced_at")))


@query(_BASE + _MATCHED + " select * from classed")
def history_lineage(spark, sf_dir):
    """Which run made what another one read."""
    return _lineage(spark, sf_dir).select("dst", F.col("input.pos").cast("bigint").alias("pos"), "src", "class")


@query(_BASE + _MATCHED + " select count(*) as inputs, count(*) filter (class = 'resolvable') as resolvable, count(*) filter (class = 'unsequenced') as unsequenced, count(*) filter (class <> 'resolvable') as orphan, 0::bigint as ambiguous from classed")
def history_lineage_counts(spark, sf_dir):
    """The counters of the lineage answer (A10)."""
    return lineage.counts(_lineage(spark, sf_dir))


@query(_BASE + _MATCHED + " select src, dst, count(*) as n from classed where src is not null group by all")
def history_edges(spark, sf_dir):
    """The run graph as a bag of edges."""
    return lineage.edges(_lineage(spark, sf_dir)).groupBy("src", "dst").agg(F.count("*").alias("n"))


_FACTS = """, f as (select k, uid, script, status, coalesce(k % 11 <> 0 and k % 3 <> 0, false) as captured, k % 5 = 0 as dirty, case when k % 7 <> 0 then 'c' || k else '' end as cmt, k % 17 <> 0 as observed, k % 19 = 0 and k % 17 <> 0 as cut, k % 6 = 0 as reads,
  case when k % 17 <> 0 then [case k % 4 when 0 then 'all' when 1 then 'none' when 2 then 'snapshot' end] else [null] end[1] as said, k % 23 = 0 as err, case when k % 8 <> 0 then k % 9 end as pk,
  exists (select 1 from i where i.k = d.k and role = 'input') as has_in, exists (select 1 from i where i.k = d.k and role = 'output') as has_out from d),
a as (select uid, 'clean_tree' as rule, case when not captured then 'CANNOT_CHECK' when dirty then 'VIOLATED' else 'MET' end as verdict from f
 union all select uid, 'commit_recorded', case when not captured then 'CANNOT_CHECK' when cmt = '' then 'VIOLATED' else 'MET' end from f
 union all select uid, 'no_unregistered_reads', case when not observed then 'CANNOT_CHECK' when reads then 'VIOLATED' when cut then 'CANNOT_CHECK' else 'MET' end from f
 union all select uid, 'outputs_pin_inputs', case when not has_out then 'CANNOT_CHECK' when not has_in then 'VIOLATED' else 'MET' end from f
 union all select uid, 'environment_captured', case when said = 'none' then 'VIOLATED' when said is null or err or (said = 'snapshot' and pk is null) then 'CANNOT_CHECK' else 'MET' end from f
 union all select uid, 'finished_ok', case when status is null then 'CANNOT_CHECK' when status <> 'ok' then 'VIOLATED' else 'MET' end from f)"""


@query(_BASE + _FACTS + " select uid, rule, verdict from a")
def history_rules(spark, sf_dir):
    """The six rules over every run."""
    found = policy.answers(_runs(spark, sf_dir), ("clean_tree", "commit_recorded", "no_unregistered_reads", "outputs_pin_inputs", "environment_captured", "finished_ok"), ["address"])
    return found.select(F.col("address").alias("uid"), "rule", "verdict")


_OUTCOME = "case when count(*) filter (verdict = 'VIOLATED') > 0 then 'VIOLATED' when count(*) filter (verdict = 'CANNOT_CHECK') > 0 then 'CANNOT_CHECK' else 'MET' end"


@query(_BASE + _FACTS + f", g as (select rule, count(*) as evaluated, count(*) filter (verdict = 'MET') as n_met, count(*) filter (verdict = 'VIOLATED') as n_violated, count(*) filter (verdict = 'CANNOT_CHECK') as n_cannot_check, {_OUTCOME} as outcome from a group by rule) select *, case outcome when 'VIOLATED' then 1 when 'CANNOT_CHECK' then 2 else 0 end as exit_code from g")
def history_gate(spark, sf_dir):
    """Each rule's outcome over all runs, with its denominator and exit code (A3, A4)."""
    named = ("clean_tree", "commit_recorded", "no_unregistered_reads", "outputs_pin_inputs", "environment_captured", "finished_ok")
    found = policy.assess(policy.answers(_runs(spark, sf_dir), named), ["rule"])
    return found.withColumn("exit_code", tristate.exit_code(F.col("outcome"), (tristate.VIOLATED,), (tristate.CANNOT_CHECK,)))


@query(_BASE + """, e as (select i.uid, case when i.size % 7 = 0 then null else i.sha end as sha, case when p.p_partkey is null then null when p.p_size % 9 = 0 then 'moved' else i.sha end as now from i left join part p on 'in/' || p.p_partkey = i.path and p.p_size % 10 <> 0 where role = 'input')
select uid, case when count(*) filter (sha <> now) > 0 then 'VIOLATED' when count(*) filter (sha is null or now is null) > 0 then 'CANNOT_CHECK' else 'MET' end as verdict from e group by uid""")
def history_inputs_verify(spark, sf_dir):
    """Whether the inputs of each run still are what they were (R7, J12): parts are what stands there now."""
    io = graph.cut(history.io_entries(_runs(spark, sf_dir)).filter("role = 'input'").select("address", "path", "sha256", "size"), "io")
    part = _t(spark, sf_dir, "part", "p_partkey", "p_size").filter("p_size % 10 <> 0").select(F.concat(F.lit("in/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") % 9 == 0).alias("moved"))
    # what stands at a path depends on the digest that is asked for: three digests of each part are on record
    recorded = io.select(F.col("address").alias("run"), F.concat_ws("|", "path", "sha256").alias("path"), F.lit("file").alias("kind"), F.when(F.col("size") % 7 != 0, F.col("sha256")).alias("digest"))
    current = io.select("path", "sha256").distinct().join(part, "path").select(F.concat_ws("|", "path", "sha256").alias("path"), F.when(F.col("moved"), "moved").otherwise(F.col("sha256")).alias("digest"))
    return policy.inputs_verify(recorded, current).select(F.col("run").alias("uid"), "verdict")


@query(_BASE + "select script, count(*) as runs, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'failed') as failed, arg_min(started, k) as first_started, arg_max(started, k) as last_started from d group by script")
def history_scripts(spark, sf_dir):
    """What is known of each script; a run of unknown status counts as neither (A1)."""
    runs = _runs(spark, sf_dir)
    return views.project_view(runs, "script", "position", "started_utc", F.col("status") == "ok", F.col("status") == "failed")


@query(_BASE + """, v as (select script, role as kind, path as value from i join d using (k) union select script, 'parameter', 'priority' from d union select script, 'parameter', 'seed' from d where k % 2 = 0)
select script, kind, count(*) as n, min(value) as least, max(value) as greatest from v group by script, kind""")
def history_script_values(spark, sf_dir):
    """The distinct paths and parameter names of each script, a row for each, counted here (A1)."""
    found = views.script_values(_runs(spark, sf_dir))
    return found.filter("kind <> 'note'").groupBy("script", "kind").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))


@query(_BASE + """select uid as address, script, coalesce(status, 'unknown') as status, started, finished, case when k % 7 <> 0 then 'c' || k else '?' end as commit,
 (select count(*) from i where i.k = d.k and role = 'input') as n_inputs, (select count(*) from i where i.k = d.k and role = 'output') as n_outputs from d""")
def history_run_view(spark, sf_dir):
    """One flat row for each run."""
    return facts.run_view(_runs(spark, sf_dir))


@query(_BASE + "select path, arg_max(uid, (i.k, pos)) as writer, arg_max(sha, (i.k, pos)) as sha256 from i where role = 'output' group by path")
def history_writers(spark, sf_dir):
    """The last run that wrote each artifact (A2)."""
    io = history.io_entries(_runs(spark, sf_dir)).filter("role = 'output'").withColumn("k", F.substr("address", F.lit(2)).cast("bigint"))
    return views.latest(io.withColumnRenamed("address", "writer"), ["path"], ["k", "pos"], "writer", "sha256")


@query(_BASE + """select file, k, 0 as n, case k % 4 when 0 then 'GENESIS' when 1 then sha256(k::varchar) end as claim, true as readable, false as merged,
  case when k % 13 <> 0 and k % 5 <> 0 then '0.' || (k % 12) || '.1' end as version from o
union all select file, k, 1, null, true, false, case when k % 5 <> 0 then '0.' || (k % 12) || '.1' end from d
union all select file, k, 2, case when k % 50 = 9 then 'GENESIS' end, false, k % 50 = 13, null from o where k % 50 in (7, 9, 11, 13, 15)""")
def history_claims(spark, sf_dir):
    """What each line claims, whether two records share it, and the version of its writer: its own, else its run's."""
    found = history.with_versions(graph.cut(history.claims(_parsed(spark, sf_dir)).drop("digest", "digest_without_cr"), "claims"))
    return found.select(F.col("chain").alias("file"), F.col("position.block").alias("k"), F.col("position.row").cast("int").alias("n"), "claim", "readable", "merged", "version")


@query(_BASE + "select count(*) as total, count(*) filter (script = 'job3.py') as matching, count(*) filter (script = 'job3.py' and status = 'failed') as failed, least(count(*) filter (script = 'job3.py'), 5) as shown, count(*) filter (script = 'job3.py') > 0 as matched_any from d")
def history_log(spark, sf_dir):
    """The counters of the log, filtered by script and cut to five."""
    return views.log_counters(_runs(spark, sf_dir), F.col("script") == "job3.py", F.col("status") == "failed", 5)


@query(_BASE + ", m as (select uid, k, count(*) over () as matching from d where script = 'job3.py') select uid, 0 as bucket, matching from m order by k desc limit 20")
def history_select(spark, sf_dir):
    """The last 20 runs of the best way in which a name matches: script, uid, or path."""
    runs = _runs(spark, sf_dir)
    names = F.transform(F.concat("inputs", "outputs"), lambda e: e["path"])
    bucket = F.when(F.col("script") == "job3.py", 0).when(F.startswith("run_uid", F.lit("job3.py")), 1).when(F.array_contains(names, "job3.py"), 3)
    matching = graph.cut(runs.select("run_uid", "position", bucket.alias("bucket")).filter("bucket is not null"), "matching")
    return views.select_runs(matching, F.col("bucket"), "position", 20).select(F.col("run_uid").alias("uid"), F.col("bucket").cast("int").alias("bucket"), "matching")


@query(_BASE + """, w as (select 'out/' || p_partkey as path, sha256(p_partkey || ':' || (p_size % 3)) as sha from part where p_size % 2 = 0 union all select 'new/' || p_partkey, sha256(p_partkey || ':' || (p_size % 3)) from part where p_size % 2 = 1),
bp as (select path, arg_max(uid, (i.k, pos)) as r from i where role = 'output' group by path), bd as (select sha, min(uid) as one, min(uid) = max(uid) as uniq from i where role = 'output' group by sha)
select w.path as artifact, coalesce(bp.r, case when uniq then one end) as run, case when bp.r is not null then 'path' when uniq then 'digest' else 'none' end as how from w left join bp on bp.path = w.path left join bd on bd.sha = w.sha""")
def history_find_match(spark, sf_dir):
    """The run of an artifact: the last that wrote its path, else the one that recorded its bytes."""
    io = graph.cut(history.io_entries(_runs(spark, sf_dir)).filter("role = 'output'").select("address", "path", "sha256", "pos"), "io")
    outputs = io.select(F.col("address").alias("run"), "path", "sha256", F.struct(F.substr("address", F.lit(2)).cast("bigint").alias("k"), "pos").alias("order"))
    even = F.when(F.col("p_size") % 2 == 0, "out/").otherwise("new/")
    key = F.col("p_partkey").cast("string")
    artifacts = _t(spark, sf_dir, "part", "p_partkey", "p_size").select(F.concat(even, key).alias("path"), F.sha2(F.concat_ws(":", key, (F.col("p_size") % 3).cast("string")).cast("binary"), 256).alias("sha256"))
    return reports.find_match(outputs, artifacts)


@query(_BASE + "select script, arg_max(uid, k) as uid, arg_max(price / 100, k) as wall_seconds, arg_max(k % 4096 * 1048576, k) as rss from d where k % 3 <> 0 group by script")
def history_resources(spark, sf_dir):
    """The last run of each script that has figures, and these."""
    runs = _runs(spark, sf_dir).filter("resources is not null").select("script", "position", F.col("run_uid").alias("uid"), F.col("resources.wall_seconds").alias("wall_seconds"), F.col("resources.max_rss_bytes").alias("rss"))
    return views.latest(runs, ["script"], ["position"], "uid", "wall_seconds", "rss")


@query(_BASE + """, x as (select script, k, lead(k) over w as nk, price / 100 as a, lead(price / 100) over w as b from d where k % 3 <> 0 window w as (partition by script order by k))
select script, k, case when a = b then false else abs(a - b) > greatest(abs(a), abs(b)) * 0.05 and abs(a - b) > 0.5 end as material from x where nk is not null""")
def history_resource_diff(spark, sf_dir):
    """Whether the time of each run differs materially from that of the script's next run."""
    runs = _runs(spark, sf_dir).filter("resources is not null").select("script", F.substr("address", F.lit(2)).cast("bigint").alias("k"), F.col("resources.wall_seconds").alias("a"))
    pairs = views.with_next(graph.cut(runs, "figures"), "script", "k", "a", "b").filter("b is not null")
    return pairs.select("script", "k", compare.material(F.col("a"), F.col("b"), 0.5).alias("material"))


@query(_BASE + """, b as (select min(uid) filter (k = lo) as a, min(uid) filter (k = hi) as b from d, (select min(k) as lo, max(k) as hi from d)),
f as (select 'input' as role union all select 'output'),
x as (select role, path, max(sha) as v, count(distinct sha) as n from i, b where i.uid = b.a group by role, path), y as (select role, path, max(sha) as v from i, b where i.uid = b.b group by role, path),
z as (select coalesce(x.role, y.role) as role, x.v is distinct from y.v as differs from x full join y on x.role = y.role and x.path = y.path)
select f.role, count(z.role) as examined, count(*) filter (z.differs) as differences from f left join z on z.role = f.role group by f.role""")
def history_file_diff(spark, sf_dir):
    """Inputs and outputs of the first and the last run against each other."""
    runs = _kept_runs(spark, sf_dir)
    io = history.io_entries(runs).withColumn("k", F.substr("address", F.lit(2)).cast("bigint"))
    ends = runs.agg(F.min(F.substr("address", F.lit(2)).cast("bigint")).alias("lo"), F.max(F.substr("address", F.lit(2)).cast("bigint")).alias("hi"))  # one row
    both = io.join(F.broadcast(ends), (F.col("k") == F.col("lo")) | (F.col("k") == F.col("hi")))
    side = lambda c: both.filter(F.col("k") == F.col(c)).groupBy("role", "path").agg(F.max("sha256").alias("value"))
    found = compare.map_diff(side("lo"), side("hi"), ["role", "path"])
    roles = spark.createDataFrame([("input",), ("output",)], "role string")
    return roles.join(found, "role", "left").groupBy("role").agg(F.count("path").alias("examined"), F.count_if(F.col("change") != compare.SAME).alias("differences"))


@query(_BASE + """, pins as (select 'a' || k as artifact, count(*) filter (role = 'input') as carried from i group by k),
ck as (select 'a' || i.k as artifact, case when i.size % 11 = 0 then 'UNVERIFIABLE' when p.p_partkey is null then 'GONE' when p.p_size % 9 = 0 then 'STALE' else 'OK' end as status from i left join part p on 'in/' || p.p_partkey = i.path and p.p_size % 10 <> 0 where role = 'input'),
t as (select artifact, count(*) as inputs, count(*) filter (status = 'OK') as ok, count(*) filter (status = 'STALE') as stale, count(*) filter (status = 'GONE') as gone from ck group by artifact),
s as (select 'a' || d.k as artifact, case when p.artifact is null then 'NO PIN' when d.k % 29 = 0 then 'ALTERED' when coalesce(t.stale, 0) > 0 or d.k % 31 = 0 then 'STALE' when coalesce(t.gone, 0) > 0 then 'GONE'
  when coalesce(t.inputs, 0) > 0 and t.ok = t.inputs then 'OK' when coalesce(t.inputs, 0) = 0 and p.carried = 0 then 'OK' else 'UNVERIFIABLE' end as status, coalesce(t.inputs, 0) as inputs from d left join pins p on p.artifact = 'a' || d.k left join t on t.artifact = 'a' || d.k)
select * from s""")
def history_verify(spark, sf_dir):
    """Each run's artifact against its pin and its inputs."""
    return _verified(spark, sf_dir).select("artifact", "status", "inputs")


def _verified(spark, sf_dir):
    runs = _kept_runs(spark, sf_dir)
    k = F.substr("address", F.lit(2)).cast("bigint")
    io = history.io_entries(runs).withColumns({"k": k, "artifact": F.concat(F.lit("a"), F.substr("address", F.lit(2)))})
    part = _t(spark, sf_dir, "part", "p_partkey", "p_size").filter("p_size % 10 <> 0").select(F.concat(F.lit("in/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") % 9 == 0).alias("moved"))
    pinned = facts.displayed(F.col("sha256"))
    name = F.concat_ws("|", "path", "sha256")
    entries = io.filter("role = 'input'").select("artifact", F.lit(0).alias("pin_no"), name.alias("name"), F.when(F.col("size") % 11 == 0, "MISSING").otherwise(pinned).alias("pinned"))
    current = io.filter("role = 'input'").select("path", "sha256").distinct().join(part, "path").select(name.alias("name"), F.when(F.col("moved"), "moved").otherwise(pinned).alias("digest"))
    blocks = io.groupBy("artifact", "k").agg(F.count_if(F.col("role") == "input").alias("carried"))
    pins = blocks.select("artifact", F.lit(0).alias("pin_no"), (F.col("carried") + F.when(F.col("k") % 31 == 0, 1).otherwise(0)).alias("declared"), "carried", F.lit("body").alias("body"), F.when(F.col("k") % 29 == 0, "other").otherwise("body").alias("body_now"))
    return verify.artifact_status(pins, verify.check_inputs(entries, current), runs.select(F.concat(F.lit("a"), F.substr("address", F.lit(2))).alias("artifact")))


@query("with s as (select * from (" + history_verify.sql.strip() + """)) select count(*) as seen, count(*) filter (status <> 'NO PIN') as pinned, count(*) filter (status = 'OK') as ok, count(*) filter (status = 'STALE') as stale, count(*) filter (status = 'ALTERED') as altered, count(*) filter (status = 'GONE') as gone,
 count(*) filter (status = 'UNVERIFIABLE') as unverifiable, count(*) filter (status <> 'NO PIN') as body_checked, cast(null as varchar) as cannot_check, case when count(*) filter (status in ('STALE', 'ALTERED', 'GONE')) > 0 then 1 when count(*) filter (status = 'OK') = 0 then 2 else 0 end as exit_code from s""")
def history_verify_report(spark, sf_dir):
    """The counters of verification, why nothing could be checked, and the exit code."""
    return verify.verify_report(_verified(spark, sf_dir))


@query(_BASE + """, e as (select uid, path, sha from i where role = 'output') select 'entity' as section, count(distinct path) as n from i union all select 'activity', count(*) from d union all select 'agent', count(distinct script) from d union all select 'wasAssociatedWith', count(*) from d
union all select 'used', count(*) from (select distinct uid, path from i where role = 'input') union all select 'wasGeneratedBy', count(*) from (select distinct uid, path from e)
union all select 'wasDerivedFrom', count(*) from (select distinct a.uid, a.path, b.path from e a join i b on a.uid = b.uid and b.role = 'input')""")
def history_prov(spark, sf_dir):
    """The sections of the provenance document of a whole history."""
    runs = _kept_runs(spark, sf_dir, "script")
    io = history.io_entries(runs).select(F.col("address").alias("run"), "role", "path", F.col("sha256").alias("digest"), "pos").withColumnRenamed("pos", "order")
    return exports.prov_document(runs.select(F.col("address").alias("run"), "script", "started_utc", "finished_utc"), io).groupBy("section").agg(F.count("*").alias("n"))


@query(_BASE + "select 'CreateAction' as type, count(*) as n, count(*) as ids from d union all select 'SoftwareApplication', count(distinct script), count(distinct script) from d union all select 'File', count(distinct path), count(distinct path) from i union all select 'Dataset', 1, 1 union all select 'CreativeWork', 1, 1")
def history_crate(spark, sf_dir):
    """The nodes of the research-object crate of a whole history, each id once."""
    runs = _kept_runs(spark, sf_dir, "script")
    io = history.io_entries(runs).select(F.col("address").alias("run"), "role", "path", F.col("sha256").alias("digest"), "pos").withColumnRenamed("pos", "order")
    return exports.crate_graph(runs.select(F.col("address").alias("run"), "script", "started_utc", "finished_utc"), io).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("select event_id, substr(coalesce(nullif(case when event_id % 3 = 0 then sha256(event_type) else '' end, ''), nullif(case when event_id % 5 = 0 then sha256(props) end, ''), case when event_id % 7 = 0 then sha256(user_id::varchar) end, 'MISSING'), 1, 16) as pin, case when event_id % 3 = 0 then 'content_sha256' when event_id % 5 = 0 and props is not null then 'sha256' when event_id % 7 = 0 then 'sha256_tree' end as key, sha256(props) as line from events")
def entry_digests(spark, sf_dir):
    """What a pin quotes of an entry, the key it comes from, and the digest of a line."""
    e = _t(spark, sf_dir, "events")
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    content, raw, tree = F.when(F.col("event_id") % 3 == 0, hashed(F.col("event_type"))).otherwise(""), F.when(F.col("event_id") % 5 == 0, hashed(F.col("props"))), F.when(F.col("event_id") % 7 == 0, hashed(F.col("user_id").cast("string")))
    return e.select("event_id", dg.pin_digest(content, raw, tree).alias("pin"), facts.recorded_pair(content, raw, tree)[1].alias("key"), hashed(F.col("props")).alias("line"))


@query("""with r as (select doc_id, '{"started_utc": "' || source || '", "n": ' || n_chars || ', "built_at" : "x"}' || chr(10) as t from documents)
select doc_id, sha256('{"started_utc": "", "n": ' || n_chars || ', "built_at": ""}') as sha256 from documents""")
def record_stamps(spark, sf_dir):
    """The digest of the engine's own records: stamps are blanked, keys stay (H3)."""
    text = F.concat(F.lit('{"started_utc": "'), "source", F.lit('", "n": '), F.col("n_chars").cast("string"), F.lit(', "built_at" : "x"}\n'))
    return _t(spark, sf_dir, "documents", "doc_id", "source", "n_chars").select("doc_id", dg.record_digest(text).alias("sha256"))


@query("""with e as (select source, upper(lang) || '/' || doc_id as n, sha256(text) as h from documents)
select source, sha256(string_agg(n || chr(0) || h || chr(0), '' order by string_split(lower(n), '/'))) as casefolded, count(*) as n_files from e group by source""")
def tree_digest_casefolded(spark, sf_dir):
    """The digest of a tree in the order of its lower-case names (H8)."""
    files = _t(spark, sf_dir, "documents", "doc_id", "lang", "source", "text").select("source", F.concat_ws("/", F.upper("lang"), F.col("doc_id").cast("string")).alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return dg.tree_digest(files, ["source"], "name", "digest", casefold=True, into="casefolded")


@query("""with r as (select l_orderkey as run, 'd/' || l_partkey as path, case when l_linenumber % 4 = 3 then 'directory' when l_linenumber % 4 = 2 then 'file' end as kind, case when l_suppkey % 6 <> 0 then l_quantity::bigint end as size, l_linenumber % 3 as m from lineitem),
c as (select '/w/d/' || p_partkey as at, p_size as size, p_partkey % 3 as m from part where p_partkey % 8 <> 0)
select run, path, case when coalesce(kind, 'file') <> 'file' or r.size is null then null when c.at is null then 'gone' when r.size <> c.size then 'size' when r.m <> c.m then 'mtime' end as moved from r left join c on c.at = '/w/' || path""")
def moved_since(spark, sf_dir):
    """Which recorded files are gone or have another size or time."""
    l = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    kind = F.when(F.col("l_linenumber") % 4 == 3, "directory").when(F.col("l_linenumber") % 4 == 2, "file")
    recorded = l.select(F.col("l_orderkey").alias("run"), F.concat(F.lit("d/"), F.col("l_partkey").cast("string")).alias("path"), F.lit("\\w\\").alias("cwd"), kind.alias("kind"), F.when(F.col("l_suppkey") % 6 != 0, F.col("l_quantity").cast("bigint")).alias("size"), (F.col("l_linenumber") % 3).alias("mtime"))
    now = _t(spark, sf_dir, "part", "p_partkey", "p_size").filter("p_partkey % 8 <> 0").select(F.concat(F.lit("/w/d/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("size"), (F.col("p_partkey") % 3).alias("mtime"))
    return facts.moved_since(recorded, now)


@query("""with e as (select c_nationkey as run, sha256(c_name) || '  ' || c_name || chr(10) as line, row_number() over (partition by c_nationkey order by c_name, sha256(c_name)) as n from customer)
select run, least(count(*), 20) as count, sha256(string_agg(line, '' order by n) filter (n <= 20)) as digest, greatest(count(*) - 20, 0) as omitted from e group by run""")
def imported_code(spark, sf_dir):
    """The digest of a run's first imported files and how many it leaves out."""
    files = _t(spark, sf_dir, "customer", "c_nationkey", "c_name").select(F.col("c_nationkey").alias("run"), F.col("c_name").alias("path"), F.sha2(F.col("c_name").cast("binary"), 256).alias("sha"))
    return facts.imported_code(files, "run", "path", "sha", limit=20)


@query("""with e as (select event_type as function, user_id as signature, count(*) as n from events group by all), t as (select function, sum(n)::bigint as calls from e group by function order by calls desc, function limit 3),
r as (select function, calls, signature, n, row_number() over (partition by function order by n desc, signature) as k from e join t using (function)) select function, calls, signature, n from r where k <= 32""")
def call_census(spark, sf_dir):
    """The most called functions and their most frequent signatures."""
    return facts.census(_t(spark, sf_dir, "events", "event_type", "user_id"), "event_type", "user_id", functions=3)


@query("""select page_id, case when starts_with(url, 'https:/') then substr(url, 8) else url end as short, replace(url, '/', '\\') as windows, url as posix from pages""")
def path_spellings(spark, sf_dir):
    """Paths relative to a root, and in one spelling."""
    p = _t(spark, sf_dir, "pages", "page_id", "url").withColumn("windows", F.translate("url", "/", "\\"))
    return p.select("page_id", facts.shortened(F.col("url"), F.lit("https:")).alias("short"), "windows", facts.posix(F.col("windows")).alias("posix"))


@query("select lang, doc_id, n_chars from (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id desc) as n from documents) where n <= 10")
def capped_listing(spark, sf_dir):
    """The last ten of each group, as listings show them."""
    docs = _t(spark, sf_dir, "documents", "lang", "doc_id", "n_chars").withColumn("order", F.struct("n_chars", "doc_id"))
    return views.ranked_last(docs, ["lang"], "order", 10).drop("order")
