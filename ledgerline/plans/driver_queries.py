"""Each kernel bound to the driver's tables, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import digest as dg
from ledgerline.functions.tristate import CANNOT_CHECK, MET, VIOLATED
from ledgerline.operators import chain, compare, exports, graph, lineage, maintenance, policy, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__], f.sql = f, sql
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


_LINES = "list_filter(string_split(regexp_replace(regexp_replace(coalesce({t}, ''), chr(13) || chr(10) || '?', chr(10), 'g'), chr(10) || '\\z', ''), chr(10)), lambda l: not regexp_matches(l, '^#\\s*(built_utc|generated_utc|run_utc|built_at)\\b'))"


@query(f"select doc_id, sha256(array_to_string({_LINES.format(t='text')}, chr(10))) as content_sha256 from documents")
def content_digest(spark, sf_dir):
    return _t(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", dg.content_digest(F.coalesce("text", F.lit(""))).alias("content_sha256"))


@query(f"""
with stamped as (select doc_id, text, '# built_utc: ' || doc_id || chr(10) || text || chr(10) || '#  run_utc now' || chr(10) as s from documents)
select doc_id, sha256(array_to_string({_LINES.format(t='s')}, chr(10))) as stamped_sha256, len({_LINES.format(t='s')}) as kept from stamped""")
def volatile_lines(spark, sf_dir):
    stamped = F.concat(F.lit("# built_utc: "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n#  run_utc now\n"))
    s = F.coalesce(stamped, F.lit(""))
    return _t(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", dg.content_digest(s).alias("stamped_sha256"), F.size(dg.stable_lines(s)).cast("bigint").alias("kept"))


@query("""
with e as (select source, lang || '/' || doc_id as n, sha256(text) as h from documents)
select source, sha256(string_agg(n || chr(0) || h || chr(0), '' order by string_split(n, '/'))) as sha256_tree, count(*) as n_files from e group by source""")
def tree_digest(spark, sf_dir):
    files = _t(spark, sf_dir, "documents", "doc_id", "lang", "source", "text").select("source", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return dg.tree_digest(files, ["source"], "name", "digest")


def _resolved(spark, sf_dir):
    events = _t(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    made = events.filter("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("src"), F.col("user_id").alias("digest"), F.col("ts").alias("at"))
    read = events.filter("event_type = 'view'").select(F.col("event_id").alias("input"), F.col("event_id").cast("string").alias("dst"), F.col("user_id").alias("digest"), F.col("ts").alias("at"))
    return lineage.resolve_ordered(made, read)


_RESOLVED = """
with p as (select cast(event_id as varchar) as src, user_id, ts from events where event_type = 'purchase'),
c as (select event_id as input, cast(event_id as varchar) as dst, user_id, ts from events where event_type = 'view'),
r as (select c.input, c.dst, arg_max(p.src, (p.ts, p.src)) filter (where p.ts <= c.ts) as src, count(p.src) as n from c left join p on p.user_id = c.user_id group by c.input, c.dst),
resolved as (select input, dst, src, case when src is not null then 'resolvable' when n > 0 then 'unsequenced' else 'orphan' end as class from r)"""


@query(_RESOLVED + " select * from resolved")
def lineage_edges(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query(_RESOLVED + """ select count(*) as inputs, count(*) filter (class = 'resolvable') as resolvable, count(*) filter (class = 'unsequenced') as unsequenced,
 count(*) filter (class <> 'resolvable') as orphan, 0::bigint as ambiguous from resolved""")
def lineage_counts(spark, sf_dir):
    return lineage.counts(_resolved(spark, sf_dir))


@query("""
with p as (select s_suppkey::varchar as src, s_nationkey as d, lpad(((s_suppkey * 37) % 1000)::varchar, 4, '0') as tm from supplier),
c as (select c_custkey as input, c_custkey::varchar as dst, c_nationkey as d, lpad(((c_custkey * 91) % 1000)::varchar, 4, '0') as tm from customer),
cd as (select input, dst, d, tm from c union all select input, dst, (d + 7) % 25, tm from c where input % 3 = 0),
r as (select cd.input, cd.dst, arg_max(p.src, (p.tm, p.src)) filter (where p.tm <= cd.tm) as src, count(p.src) as n from cd left join p on p.d = cd.d and p.src <> cd.dst group by cd.input, cd.dst)
select input, dst, src, case when src is not null then 'resolvable' when n > 0 then 'unsequenced' else 'orphan' end as class from r""")
def lineage_many_digests(spark, sf_dir):
    """The join form: inputs that bear several digests, and runs that would be their own producers."""
    time = lambda c, k: F.lpad(((F.col(c) * k) % 1000).cast("string"), 4, "0")
    made = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("src"), F.col("s_nationkey").alias("digest"), time("s_suppkey", 37).alias("at"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input"), F.col("c_custkey").cast("string").alias("dst"), F.col("c_nationkey").alias("digest"), time("c_custkey", 91).alias("at"))
    read = c.unionByName(c.filter("input % 3 = 0").withColumn("digest", (F.col("digest") + 7) % 25))
    return lineage.resolve(made, read)


def _turns(spark, sf_dir):
    """Edges from each turn to the next and the first turns of all conversations."""
    turns = _t(spark, sf_dir, "conversations", "conv_id", "turn").distinct()
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    edges = turns.join(nxt, ["conv_id", "turn"]).select(name(F.col("turn")).alias("src"), name(F.col("turn") + 1).alias("dst"))
    seeds = turns.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(name(F.col("turn")).alias("node"))
    return edges, seeds


@query("""
with recursive e as (select conv_id || ':' || turn as src, conv_id || ':' || (turn + 1) as dst from conversations c where exists (select 1 from conversations d where d.conv_id = c.conv_id and d.turn = c.turn + 1)),
first as (select conv_id || ':' || min(turn) as node from conversations group by conv_id),
w(node, depth) as (select node, 1 from first union all select e.dst, w.depth + 1 from w join e on e.src = w.node where w.depth < 5)
select node, min(depth) as depth, min(depth) > 4 as beyond from w group by node""")
def impact_bfs(spark, sf_dir):
    return graph.walk(*_turns(spark, sf_dir), max_depth=4)


@query("""
with recursive t as (select distinct conv_id, turn from conversations), e as (select t.conv_id || ':' || t.turn as src, t.conv_id || ':' || (t.turn + 1) as dst from t join t u on u.conv_id = t.conv_id and u.turn = t.turn + 1),
first as (select conv_id || ':' || min(turn) as node from t group by conv_id),
w(node, depth) as (select node, 1 from first union select e.dst, w.depth + 1 from w join e on e.src = w.node)
select node, min(depth) as depth from w group by node""")
def impact_unlimited(spark, sf_dir):
    """The walk of impact_bfs to its end: every turn that follows a conversation's first without a gap."""
    return graph.walk(*_turns(spark, sf_dir)).drop("beyond")


@query("""
with recursive e as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem where l_orderkey % 2 = 0 union select distinct 'p' || l_partkey, 's' || l_suppkey from lineitem where l_orderkey % 2 = 1),
w(node, depth) as (select 's1', 1 union select e.dst, w.depth + 1 from w join e on e.src = w.node where w.depth < 6)
select node, min(depth) as depth from w group by node""")
def import_closure(spark, sf_dir):
    """Reachability within six steps over all rows: orders of even keys lead from supplier to part, others back; import_closure_whole has no bound."""
    rows = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_partkey")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    kind = F.col("l_orderkey") % 2
    edges = rows.filter(kind == 0).select(s.alias("src"), p.alias("dst")).unionAll(rows.filter(kind == 1).select(p, s))
    return graph.walk(edges, spark.createDataFrame([("s1",)], "node string"), max_depth=6).filter("not beyond").drop("beyond")


@query()
def import_closure_whole(spark, sf_dir):
    """All that s1 reaches over all rows, to the fixed point: orders of even keys lead from supplier to part, others back.

    The least depth of each node has no SQL that ends on cycles without a bound; a test
    compares it with a walk in plain Python.
    """
    rows = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_partkey").dropna(subset=["l_suppkey", "l_partkey"])
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    even = F.coalesce(F.col("l_orderkey") % 2 == 0, F.lit(False))
    edges = rows.filter(even).select(s.alias("src"), p.alias("dst")).unionAll(rows.filter(~even).select(p, s))
    return graph.walk(edges, spark.createDataFrame([("s1",)], "node string")).drop("beyond")


@query("select conv_id, turn, sha256(text) as digest, lag(sha256(text)) over (partition by conv_id order by turn) as before from conversations")
def hash_chain(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return _t(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("digest", digest).select("conv_id", "turn", "digest", F.lag("digest").over(order).alias("before"))


_CHAIN = """
with d as (select conv_id, turn, sha256(text) as digest, lag(sha256(text)) over w as before, row_number() over w as n, (conv_id * 31 + turn) as k from conversations window w as (partition by conv_id order by turn)),
c as (select *, case when k % 11 = 3 then null when n = 1 then 'GENESIS' when k % 7 = 0 then sha256('edited') else before end as claim,
  case when k % 13 = 0 then '0.5.9' when k % 13 = 1 then null else '0.10.0' end as version, k % 17 <> 0 as readable from d),
q as (select *, lag(readable) over w as before_readable, max(claim is not null) over (partition by conv_id order by turn rows unbounded preceding) as started from c window w as (partition by conv_id order by turn)),
s as (select conv_id, turn, case
  when claim = 'GENESIS' and n > 1 then 'BROKEN' when n = 1 and claim = 'GENESIS' then 'HOLDS_TRIVIAL' when n = 1 and claim is not null then 'BROKEN'
  when n = 1 then case when not readable then 'UNCHECKABLE' else 'UNCHAINED' end
  when claim is null and not started then 'UNCHAINED'
  when claim is null and not readable then 'UNCHECKABLE' when claim is null and version = '0.5.9' then 'GAP'
  when claim is null then 'UNCLAIMED'
  when not before_readable then case when claim = before then 'HOLDS' else 'UNCHECKABLE' end
  when claim = before then 'HOLDS' else 'BROKEN' end as status from q)"""


def _links(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    k = F.col("conv_id") * 31 + F.col("turn")
    rows = _t(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.withColumn("before", F.lag("digest").over(order)).withColumn("n", F.row_number().over(order))
    claim = F.when(k % 11 == 3, F.lit(None)).when(F.col("n") == 1, "GENESIS").when(k % 7 == 0, F.sha2(F.lit("edited").cast("binary"), 256)).otherwise(F.col("before"))
    version = F.when(k % 13 == 0, "0.5.9").when(k % 13 == 1, F.lit(None)).otherwise("0.10.0")
    lines = rows.select(F.col("conv_id").alias("chain"), F.col("turn").alias("position"), "digest", F.lit(None).cast("string").alias("digest_without_cr"), claim.alias("claim"), (k % 17 != 0).alias("readable"), version.alias("version"))
    return chain.links(lines)


@query(_CHAIN + " select conv_id, turn, status from s")
def chain_status(spark, sf_dir):
    return _links(spark, sf_dir).select(F.col("chain").alias("conv_id"), F.col("position").alias("turn"), "status")


@query(_CHAIN + """ select conv_id, count(*) as lines, count(*) filter (status = 'HOLDS') as attested, count(*) filter (status = 'BROKEN') as broken,
 case when count(*) filter (status = 'BROKEN') > 0 then 'BROKEN' when count(*) filter (status in ('HOLDS', 'HOLDS_TRIVIAL')) = 0 or count(*) filter (status in ('UNCHECKABLE', 'GAP', 'UNCLAIMED')) > 0 then 'CANNOT_CHECK' else 'INTACT' end as verdict
 from s group by conv_id""")
def chain_verdict(spark, sf_dir):
    return chain.report(_links(spark, sf_dir)).select(F.col("chain").alias("conv_id"), "lines", "attested", "broken", "verdict")


@query("""
with a as (select l_suppkey, count(*) as v from lineitem where l_returnflag = 'R' group by 1), b as (select l_suppkey, count(*) as v from lineitem where l_returnflag = 'A' group by 1)
select l_suppkey, a.v as value_a, b.v as value_b, case when a.v is null then 'ADDED' when b.v is null then 'REMOVED' when a.v <> b.v then 'CHANGED' else 'SAME' end as change from a full outer join b using (l_suppkey)""")
def run_diff(spark, sf_dir):
    side = lambda f: _t(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag").filter(F.col("l_returnflag") == f).groupBy("l_suppkey").agg(F.count("*").alias("value"))
    return compare.map_diff(side("R"), side("A"), ["l_suppkey"])


@query("""
with d as (select *, case when v_a is distinct from v_b then 1 else 0 end as diff from
 (select l_suppkey, count(*) as v_a from lineitem where l_returnflag = 'R' group by 1) a full outer join (select l_suppkey, count(*) as v_b from lineitem where l_returnflag = 'A' group by 1) b using (l_suppkey))
select 'lines' as dimension, count(*) as examined, sum(diff)::bigint as differences, case when sum(diff) > 0 then 'CHANGED' else 'SAME' end as verdict from d""")
def diff_dimension(spark, sf_dir):
    return compare.dimension(run_diff(spark, sf_dir), "lines").drop("blocked")


@query("""
with t as (select o_custkey, sum(o_totalprice::decimal(18,2)) filter (o_orderstatus = 'F') as a, sum(o_totalprice::decimal(18,2)) filter (o_orderstatus = 'O') as b from orders group by 1)
select o_custkey, case when a = b then false else abs(a - b)::double > greatest(abs(a), abs(b))::double * 0.05 and abs(a - b)::double > 1000.0 end as differs from t""")
def resource_diff(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    of = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, price)).cast("decimal(28,2)")
    t = _t(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice").groupBy("o_custkey").agg(of("F").alias("a"), of("O").alias("b"))
    a, b = F.col("a"), F.col("b")
    gap = F.abs(a - b).cast("double")
    differs = F.when(a == b, False).when(a.isNull() | b.isNull(), F.lit(None)).otherwise((gap > F.greatest(F.abs(a), F.abs(b)).cast("double") * 0.05) & (gap > 1000.0))
    return t.select("o_custkey", differs.alias("differs"))


_VERDICT = "case o_orderstatus when 'F' then 'MET' when 'O' then 'VIOLATED' else 'CANNOT_CHECK' end"


@query(f"""
select o_orderpriority, count(*) as evaluated, count(*) filter (v = 'MET') as n_met, count(*) filter (v = 'VIOLATED') as n_violated, count(*) filter (v = 'CANNOT_CHECK') as n_cannot_check,
 case when count(*) filter (v = 'VIOLATED') > 0 then 'VIOLATED' when count(*) filter (v = 'CANNOT_CHECK') > 0 then 'CANNOT_CHECK' else 'MET' end as outcome
 from (select o_orderpriority, {_VERDICT} as v from orders) group by 1""")
def policy_gate(spark, sf_dir):
    v = F.when(F.col("o_orderstatus") == "F", MET).when(F.col("o_orderstatus") == "O", VIOLATED).otherwise(CANNOT_CHECK)
    return policy.assess(_t(spark, sf_dir, "orders", "o_orderpriority", "o_orderstatus").withColumn("verdict", v), ["o_orderpriority"])


_RULES = {
    "finished_ok": ("o_orderstatus = 'O'", "o_orderstatus = 'P'"),
    "dear": ("o_totalprice > 400000", "o_totalprice < 1000"),
    "urgent": ("o_orderpriority = '1-URGENT'", "o_orderpriority is null"),
    "odd": ("o_orderkey % 2 = 1", "o_custkey % 5 = 0"),
    "late": ("o_orderdate > timestamp '1998-01-01'", "o_orderdate is null"),
    "never": ("false", "false"),
}


@query(" union all ".join(f"""select '{n}' as rule, count(*) as evaluated, count(*) filter (v = 'MET') as n_met, count(*) filter (v = 'VIOLATED') as n_violated, count(*) filter (v = 'CANNOT_CHECK') as n_cannot_check,
 case when count(*) filter (v = 'VIOLATED') > 0 then 'VIOLATED' when count(*) filter (v = 'CANNOT_CHECK') > 0 then 'CANNOT_CHECK' else 'MET' end as outcome
 from (select case when {w} then 'VIOLATED' when {u} then 'CANNOT_CHECK' else 'MET' end as v from orders)""" for n, (w, u) in _RULES.items()))  # fmt: skip
def policy_unpivot(spark, sf_dir):
    """Six rules in one pass over the runs."""
    from ledgerline.functions.tristate import verdict

    given = {n: verdict(F.expr(w.replace("timestamp '", "timestamp_ntz '")), F.expr(u)) for n, (w, u) in _RULES.items()}
    return policy.assess(policy.unpivoted(_t(spark, sf_dir, "orders"), given), ["rule"])


@query("""
select event_type, count(*) as runs, count(*) filter (value > 50) as ok, count(*) filter (value <= 10) as failed, arg_min(ts, event_id) as first_started, arg_max(ts, event_id) as last_started, list_sort(list(distinct user_id)) as users
 from events group by 1""")
def project_view(spark, sf_dir):
    rows = _t(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return views.project_view(rows, "event_type", "event_id", "ts", F.col("value") > 50, F.col("value") <= 10, users="user_id")


@query("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by 1, 2")
def latest_artifact(spark, sf_dir):
    return views.latest(_t(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value"), ["user_id", "event_type"], ["ts", "event_id"], "event_id", "value")


@query("""
with o as (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, max(o_orderdate) as d from orders group by 1),
s as (select l_orderkey, count(*) as n, count(*) filter (l_shipdate > d) as late from lineitem join o on l_orderkey = o_orderkey group by 1)
select o_custkey, o_orderkey, case when n is null then 'UNKNOWN' when late > 0 then 'STALE' else 'FRESH' end as state from o left join s on l_orderkey = o_orderkey""")
def staleness(spark, sf_dir):
    last = views.latest(_t(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "o_orderdate")
    ships = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate").join(last, F.col("l_orderkey") == F.col("o_orderkey"))
    counted = ships.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_shipdate") > F.col("o_orderdate")).alias("late"))
    state = F.when(F.col("n").isNull(), views.UNKNOWN).when(F.col("late") > 0, views.STALE).otherwise(views.FRESH)
    return last.join(counted, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_custkey", "o_orderkey", state.alias("state"))


_FILES = """
with f as (select c_custkey as path, c_custkey % 400 as run, c_custkey % 7 as size, c_custkey % 11 as digest from customer),
i as (select o_orderkey % 400 as run, o_custkey as path, nullif(o_orderkey % 11, 5) as digest from orders),
now as (select c_custkey as path, case when c_custkey % 97 = 0 then 8 else c_custkey % 7 end as size, case when c_custkey % 89 = 0 then null else c_custkey % 11 end as digest from customer where c_custkey % 50 <> 0)"""


@query(_FILES + """
, m as (select i.run, case when now.path is null then 'STALE' when i.digest is null or now.digest is null then 'UNKNOWN' when i.digest <> now.digest then 'STALE' else 'FRESH' end as s from i left join now using (path)),
r as (select run, count(*) filter (s = 'STALE') as stale, count(*) filter (s = 'UNKNOWN') as unknown from m group by run)
select f.path, f.run, case when now.path is null then 'GONE' when coalesce(f.size <> now.size, false) or coalesce(f.digest <> now.digest, false) then 'MODIFIED' when stale > 0 then 'STALE' when r.run is null or unknown > 0 then 'UNKNOWN' else 'FRESH' end as state
from f left join now using (path) left join r on r.run = f.run""")
def artifact_states(spark, sf_dir):
    """The whole of the staleness fold: output against now, inputs against now, worst first."""
    ids = _t(spark, sf_dir, "customer", "c_custkey").withColumn("k", F.col("c_custkey"))
    k = F.col("k")
    outputs = ids.select(k.alias("path"), (k % 400).alias("run"), (k % 7).alias("size"), (k % 11).alias("digest"))
    now = ids.filter(k % 50 != 0).select(k.alias("path"), F.when(k % 97 == 0, 8).otherwise(k % 7).alias("size"), F.when(k % 89 != 0, k % 11).alias("digest"))
    d = F.col("o_orderkey") % 11
    inputs = _t(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select((F.col("o_orderkey") % 400).alias("run"), F.col("o_custkey").alias("path"), F.when(d != 5, d).alias("digest"))
    return views.staleness(outputs, inputs, now)


@query("select event_id, user_id from events s where event_type = 'signup' and not exists (select 1 from events c where c.event_type = 'purchase' and c.user_id = s.user_id and c.ts > s.ts)")
def in_flight(spark, sf_dir):
    e = _t(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    last = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    starts = e.filter("event_type = 'signup'").join(last, "user_id", "left")
    ended = starts.filter(F.col("last") > F.col("ts")).select("event_id")
    return views.in_flight(starts.select("event_id", "user_id"), ended, "event_id")


@query("""
with b as (select o_orderkey, o_custkey, case when o_orderpriority = '0-NONE' then 0 when o_orderstatus = 'P' and o_totalprice > 300000 then 1 when o_orderstatus = 'F' then 2 end as bucket from orders),
m as (select *, min(bucket) over () as best from b where bucket is not null)
select o_orderkey, o_custkey, bucket, count(*) over () as matching from m where bucket = best order by o_orderkey desc limit 25""")
def priority_select(spark, sf_dir):
    bucket = F.when(F.col("o_orderpriority") == "0-NONE", 0).when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000), 1).when(F.col("o_orderstatus") == "F", 2)
    return views.select_runs(_t(spark, sf_dir, "orders"), bucket, "o_orderkey", 25).select("o_orderkey", "o_custkey", "bucket", "matching")


@query("select event_id, ts, user_id from events where event_type = 'error' order by event_id desc limit 20")
def log_tail(spark, sf_dir):
    return views.tail(_t(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").filter("event_type = 'error'").drop("event_type"), "event_id", 20)


@query("""
select count(*) as total, count(*) filter (event_type = 'click') as matching, count(*) filter (event_type = 'click' and value < 5) as failed, least(count(*) filter (event_type = 'click'), 50) as shown, count(*) filter (event_type = 'click') > 0 as matched_any from events""")
def log_counters(spark, sf_dir):
    return views.log_counters(_t(spark, sf_dir, "events", "event_type", "value"), F.col("event_type") == "click", F.col("value") < 5, 50)


@query("select distinct l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size < 40)")
def unregistered(spark, sf_dir):
    registered = _t(spark, sf_dir, "part", "p_partkey", "p_size").filter("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    return views.unregistered(_t(spark, sf_dir, "lineitem", "l_partkey"), registered, "l_partkey")


_LISTING = "case when p_partkey % 9 = 0 then '# note' when p_partkey % 9 = 1 then 'not a package' else replace(p_name, ' ', '_.') || '==' || p_size || '.' || (p_partkey % 10) end"


@query(f"""
with l as (select p_brand as env, p_partkey as number, {_LISTING} as line from part)
select env, number, case when line like '#%' then 'note' when regexp_full_match(line, '[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?==.+') then 'pip' else 'refused' end as kind,
 case when regexp_full_match(line, '[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?==.+') then lower(regexp_replace(split_part(line, '==', 1), '[-_.]+', '-', 'g')) end as name,
 case when regexp_full_match(line, '[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?==.+') then split_part(line, '==', 2) end as version from l""")
def snapshot_parse(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.when(k % 9 == 0, "# note").when(k % 9 == 1, "not a package").otherwise(F.concat(F.regexp_replace("p_name", " ", "_."), F.lit("=="), F.col("p_size").cast("string"), F.lit("."), (k % 10).cast("string")))
    lines = _t(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_brand").select(F.col("p_brand").alias("env"), k.alias("number"), line.alias("line"))
    return maintenance.parse_packages(lines, "env", "number", "line").select("env", "number", "kind", "name", "version")


def _package_sets(spark, sf_dir, number):
    p = _t(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").groupBy(F.col("p_brand").alias("env"), F.concat(F.lit("p"), number.cast("string")).alias("name")).agg(F.max("p_size").cast("string").alias("version"))
    rows = p.withColumns({"manager": F.lit("pip"), "build": F.lit(None).cast("string"), "kind": F.lit("pip")})
    return maintenance.package_set_digest(rows, "env", "packages.v1").select("env", "digest", "n_packages")


@query("""
with p as (select distinct p_brand as env, 'p' || p_partkey % 50 as name, max(p_size)::varchar as version from part group by 1, 2)
select env, sha256('packages.v1' || chr(10) || string_agg('pip ' || name || ' ' || version || chr(10), '' order by name)) as digest, count(*) as n_packages from p group by env""")
def package_set(spark, sf_dir):
    return _package_sets(spark, sf_dir, F.col("p_partkey") % 50)


@query("""
with p as (select p_brand as env, 'p' || p_partkey as name, max(p_size)::varchar as version from part group by 1, 2)
select env, sha256('packages.v1' || chr(10) || string_agg('pip ' || name || ' ' || version || chr(10), '' order by name)) as digest, count(*) as n_packages from p group by env""")
def package_set_whole(spark, sf_dir):
    """Environments whose packages are all parts of a brand, so that they grow with the table."""
    return _package_sets(spark, sf_dir, F.col("p_partkey"))


@query("""
with a as (select p_name as name, max(p_size)::varchar as v from part where p_partkey % 2 = 0 group by 1), b as (select p_name as name, max(p_size)::varchar as v from part where p_partkey % 2 = 1 group by 1)
select name, a.v as value_a, b.v as value_b, case when a.v is null then 'ADDED' when b.v is null then 'REMOVED' else 'CHANGED' end as change from a full outer join b using (name) where a.v is distinct from b.v""")
def package_compare(spark, sf_dir):
    """The two environments are the even and the odd parts."""
    side = lambda r: _t(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").filter(F.col("p_partkey") % 2 == r).groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").cast("string").alias("version"))
    return compare.package_diff(side(0), side(1))


@query("select doc_id, case when doc_id % 3 = 0 then left(sha256(text), 20) when doc_id % 3 = 1 then left(sha256(text), 12) else left(sha256(text || 'x'), 20) end as quoted, doc_id % 3 = 0 as identified from documents")
def prefix_identity(spark, sf_dir):
    own, other, r = F.sha2(F.col("text").cast("binary"), 256), F.sha2(F.concat("text", F.lit("x")).cast("binary"), 256), F.col("doc_id") % 3
    quoted = F.when(r == 0, F.left(own, F.lit(20))).when(r == 1, F.left(own, F.lit(12))).otherwise(F.left(other, F.lit(20)))
    return _t(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", quoted.alias("quoted"), dg.identifies(quoted, own).alias("identified"))


@query("select doc_id, lang as script, n_chars % 4 as declared, left(sha256(text), 16) as first_digest from documents")
def pin_fields(spark, sf_dir):
    """Pin headers are written around documents and read back."""
    from ledgerline.sources.pins import pins_of

    n = (F.col("n_chars") % 4).cast("int")
    entry = F.concat(F.lit("#     "), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16), F.lit("  data/in file\n"))
    count = F.when(n == 0, F.lit("#   inputs     : NONE REGISTERED\n")).otherwise(F.concat(F.lit("#   inputs ("), n.cast("string"), F.lit("), content digest:\n"), F.repeat(entry, n)))
    head = F.concat(F.lit("# provenance — this artifact and what produced it\n#   script     : "), F.col("lang"), F.lit("\n#   generation : g\n"), count, F.lit("\n"), F.col("text"))
    found = pins_of(_t(spark, sf_dir, "documents").select("doc_id", head.alias("head"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("own")), "doc_id", "head", keep=["own"])
    digest = F.when(F.col("declared") == 0, F.col("own")).otherwise(F.get(F.col("entries.digest"), F.lit(0)))
    return found.select("doc_id", F.col("fields")["script"].alias("script"), F.col("declared").cast("bigint").alias("declared"), digest.alias("first_digest"))


@query("select a.l_orderkey as run, a.l_partkey as generated, b.l_partkey as used from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey where a.l_returnflag = 'R' and b.l_returnflag <> 'R'")
def prov_derivations(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    side = lambda out: rows.filter((F.col("l_returnflag") == "R") == F.lit(out)).select(F.col("l_orderkey").alias("run"), "l_partkey")
    return exports.derivations(side(True), side(False), "run", "l_partkey", "l_partkey")


@query("select sha256(text) as path, arg_max(doc_id, (n_chars % 5, -doc_id)) as doc_id from documents group by 1")
def export_entities(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents", "doc_id", "text", "n_chars").select(F.sha2(F.col("text").cast("binary"), 256).alias("path"), "doc_id", (F.col("n_chars") % 5).alias("keys"))
    return exports.fullest(rows.withColumn("order", F.col("doc_id")), "path", "keys", "order", "doc_id")


@query("""
with r as (select o_orderkey, (o_totalprice * 100000)::bigint as rss, (o_orderkey * 40000)::bigint as vms, o_custkey as wall from orders)
select o_orderkey, ceil(rss * 1.5 / 1048576)::bigint as mem_mib, ceil(rss / 1048576)::bigint as rss_mib, case when vms >= rss then ceil(vms / 1048576)::bigint end as vms_mib, ceil(wall * 1.5 / 60)::bigint as minutes,
 printf('%d:%02d:%02d', wall // 3600, wall % 3600 // 60, wall % 60) as h_m_s from r""")
def resource_request(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_custkey")
    asked = maintenance.resource_request(F.round(F.col("o_totalprice") * 100000).cast("bigint"), F.col("o_orderkey") * 40000, F.col("o_custkey"))
    return rows.select("o_orderkey", *(c.alias(n) for n, c in asked.items()))


@query("""
with a as (select event_id, user_id % 5 <> 0 as own, case when event_type = 'click' then true when event_type = 'error' then null else false end as running, case when event_id % 23 <> 0 then epoch(timestamp '2030-01-01' - ts) end as age,
 epoch(timestamp '2030-01-01' - (select ts from events order by event_id limit 1)) as half from events)
select event_id, case when not own then 'foreign' when running then 'running' when running is null then 'untellable' when age is null then 'undateable' when age < 190000000 then 'too_new' else 'remove' end as plan from a""")
def prune_plan(spark, sf_dir):
    e = _t(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    running = F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "error", F.lit(None)).otherwise(False)
    age = F.when(F.col("event_id") % 23 != 0, F.unix_micros(F.to_timestamp(F.lit("2030-01-01 00:00:00"))) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.select("event_id", maintenance.prune_plan(F.col("user_id") % 5 != 0, running, age, 190000000).alias("plan"))


@query("""
select o_orderkey, left(sha256('d:3:{s:3:key=i:' || o_orderkey || ',s:8:priority=s:' || length(o_orderpriority) || ':' || o_orderpriority || ',s:6:urgent=b:' || (o_orderpriority = '1-URGENT')::int || '}'), 16) as digest from orders""")
def value_digest(spark, sf_dir):
    row = dg.canonical_row(key=("int", F.col("o_orderkey")), priority=("string", F.col("o_orderpriority")), urgent=("bool", F.col("o_orderpriority") == "1-URGENT"))
    return _t(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", dg.value_digest(row).alias("digest"))


@query("""
with v as (select p_partkey, p_partkey % 3 || '.' || p_size || '.' || (p_partkey % 13) || '-rc' || (p_size % 4) as version from part)
select p_partkey, version, (split_part(version, '.', 1)::int, split_part(version, '.', 2)::int, p_partkey % 13) < (0, 6, 0) as older from v""")
def version_order(spark, sf_dir):
    k = F.col("p_partkey")
    version = F.concat_ws(".", (k % 3).cast("string"), F.col("p_size").cast("string"), F.concat((k % 13).cast("string"), F.lit("-rc"), (F.col("p_size") % 4).cast("string")))
    older = dg.version_numbers(F.col("version")) < F.array(*(F.lit(n).cast("bigint") for n in chain.CHAINS_FROM))
    return _t(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", version.alias("version")).withColumn("older", older)


@query("select sha256(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def dedupe_digest(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("""
with i as (select l_orderkey as run, case when l_linenumber = 7 then 'directory' end as kind, l_partkey as path, case when l_linenumber <> 6 then l_suppkey end as digest from lineitem),
now as (select p_partkey as path, p_partkey % 100 + 1 as digest from part where p_size < 45),
v as (select run, case when kind is null and i.digest is not null and now.digest is not null then case when i.digest <> now.digest then 'VIOLATED' else 'MET' end else 'CANNOT_CHECK' end as v from i left join now using (path))
select run, case when count(*) filter (v = 'VIOLATED') > 0 then 'VIOLATED' when count(*) filter (v = 'CANNOT_CHECK') > 0 then 'CANNOT_CHECK' else 'MET' end as verdict from v group by run""")
def inputs_verify(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    inputs = rows.select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("path"), F.when(F.col("l_linenumber") == 7, "directory").alias("kind"), F.when(F.col("l_linenumber") != 6, F.col("l_suppkey")).alias("digest"))
    now = _t(spark, sf_dir, "part", "p_partkey", "p_size").filter("p_size < 45").select(F.col("p_partkey").alias("path"), (F.col("p_partkey") % 100 + 1).alias("digest"))
    return policy.inputs_verify(inputs, now)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read with the run that made what it read."""
    return lineage_edges(spark, sf_dir)
