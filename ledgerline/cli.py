"""One command for each question. Exit codes: 0 fine, 1 wrong, 2 could not be checked."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import platform
import runpy
import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import digest as dg
from ledgerline import rendering
from ledgerline.operators import chain, compare, exports, facts, graph, imports, lineage, maintenance, policy, reports, verify, views
from ledgerline.recorder import Project, Run, atomic_write, content_digest, describe, sha256_of
from ledgerline.sources import history, pins, policy_file


def _session() -> SparkSession:
    return SparkSession.builder.appName("ledgerline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _say(df: DataFrame) -> None:
    """Print an answer, a JSON object a line; answers are small by their limits."""
    for row in df.toJSON().toLocalIterator():
        print(row)


def _show_as(df: DataFrame, form: str) -> None:
    """Print rows as JSON lines, or as YAML documents one after the other, so that no answer is held whole."""
    for row in df.toJSON().toLocalIterator():
        print(rendering.to_yaml([json.loads(row)]) if form == "yaml" else row, end="" if form == "yaml" else "\n")


class Missing(Exception):
    """There is nothing that could be checked."""


def _runs(spark: SparkSession, log: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, records, completed runs) of a history."""
    if not Path(log).exists():
        raise Missing(f"no history at {log}")
    rows = history.parsed(history.lines(spark, Path(log).resolve().as_uri())).cache()
    recs = history.records(rows)
    return rows, recs, history.completed(recs).cache()


def log(a: argparse.Namespace, spark: SparkSession) -> int:
    rows, recs, runs = _runs(spark, a.log)
    if a.unreadable:
        if a.script or a.run_id or a.failed:
            raise Missing("--unreadable stands alone")
        _say(history.unreadable(rows).select("file", "raw"))
        return 0
    named, hit = [], F.lit(True)
    for column, wanted in (("script", a.script), ("run_id", a.run_id)):
        if wanted is not None:
            named.append(column)
            hit &= F.coalesce(F.col(column) == wanted, F.lit(False))
    failed = F.coalesce(F.col("status") != "ok", F.lit(True))
    if a.failed:
        hit &= failed
    counted = views.log_counters(runs, hit, failed, a.limit)
    found = runs.filter(hit).withColumn("order", F.struct("file", "position"))
    _show_as((views.tail(found, "order", a.limit) if a.limit else found.orderBy("order")).select("script", "run_uid", "run_id", "status", "started_utc", "finished_utc"), a.format)
    open_ = views.in_flight(history.starts(recs), runs).count()
    answer = counted.withColumn("unfinished", F.lit(open_)).withColumn("unreadable", F.lit(rows.filter(F.col("parse_state") == history.BAD).count()))
    _say(answer)
    return 1 if named and not answer.first()["matched_any"] else 0


def _resolved(runs: DataFrame) -> DataFrame:
    return lineage.resolve(*history.lineage_sides(history.io_entries(runs)))


def lineage_(a: argparse.Namespace, spark: SparkSession) -> int:
    _, _, runs = _runs(spark, a.log)
    found = _resolved(runs).cache()
    _say(lineage.edges(found).orderBy("src", "dst").limit(200))
    _say(lineage.counts(found))
    return 0


def impact(a: argparse.Namespace, spark: SparkSession) -> int:
    _, _, runs = _runs(spark, a.log)
    wanted = a.target.lower()
    if Path(a.target).is_file():
        digests = [sha256_of(Path(a.target)), content_digest(Path(a.target))]
    elif 16 <= len(wanted) <= 64 and set(wanted) <= set("0123456789abcdef"):
        io = history.io_entries(runs)
        digests = [r.d for r in io.select(F.explode("digests").alias("d")).filter(F.col("d").startswith(wanted)).distinct().limit(2).collect()]
        if len(digests) > 1:
            raise Missing(f"{wanted} names several digests")
    else:
        raise Missing(f"{a.target} is neither a file nor a digest")
    seeds = history.io_entries(runs).filter("role = 'input'").filter(F.exists("digests", lambda d: d.isin(digests))).select(F.col("address").alias("node")).distinct()
    edges = lineage.edges(_resolved(runs))
    found = graph.walk(edges, seeds, a.depth)
    _say(found.join(runs.select(F.col("address").alias("node"), "script"), "node", "left").orderBy("depth", "node"))
    row = found.agg(F.count_if(~F.col("beyond")).alias("reached"), F.count_if("beyond").alias("beyond")).first()
    return 1 if row["reached"] else 2 if row["beyond"] else 0


def _pick(runs: DataFrame, target: str, limit: int) -> list[str]:
    if not target:
        raise Missing("an empty name matches every run")
    paths = F.transform(F.concat(F.coalesce("inputs", F.array().cast(runs.schema["inputs"].dataType)), F.coalesce("outputs", F.array().cast(runs.schema["outputs"].dataType))), lambda e: e["path"])
    by_path = F.exists(paths, lambda p: (p == target) | (F.substring_index(p, "/", -1) == target))
    bucket = F.when(F.col("script") == target, 0).when(F.col("run_uid").startswith(target), 1).when(F.col("run_id") == target, 2).when(by_path, 3)
    picked = views.select_runs(runs.withColumn("order", F.struct("file", "position")), bucket, "order", limit)
    return [r.address for r in picked.select("address").collect()][::-1]


def diff(a: argparse.Namespace, spark: SparkSession) -> int:
    _, _, runs = _runs(spark, a.log)
    pair = _pick(runs, a.a, 1) + _pick(runs, a.b, 1) if a.b else _pick(runs, a.a, 2)
    if len(pair) < 2 or pair[0] == pair[1]:
        raise Missing("two different runs are needed")
    found = reports.diff_runs(runs, *pair).cache()
    _say(found)
    return compare.settled(found).first()["exit_code"]


def env(a: argparse.Namespace, spark: SparkSession) -> int:
    _, _, runs = _runs(spark, a.log)
    sets = []
    for target in (a.run, a.compare):
        one = runs.filter(F.col("address").isin(_pick(runs, target, 1))).select(F.get(F.map_values("environment_snapshot.package_sets"), F.lit(0)).alias("digest"), "environment_snapshot.python", "packages").first()
        if one is None:
            raise Missing(f"no run {target}")
        sets.append(one)
    rows = lambda s: spark.createDataFrame(list((s["packages"] or {}).items()), "name string, version string")
    changes = compare.package_diff(rows(sets[0]), rows(sets[1]))
    _say(changes)
    known = all(s["packages"] for s in sets)
    answer = spark.range(1).select(reports.environment_verdict(F.lit(sets[0]["digest"]), F.lit(sets[1]["digest"]), F.lit(changes.count() if known else None).cast("bigint")).alias("verdict"), F.lit(sets[0]["python"] == sets[1]["python"]).alias("same_interpreter"))
    _say(answer)
    return {"SAME": 0, "DIFFERS": 1}.get(answer.first()["verdict"], 2)


def resources(a: argparse.Namespace, spark: SparkSession) -> int:
    _, _, runs = _runs(spark, a.log)
    last = runs.filter(F.col("resources.wall_seconds").isNotNull() & (F.col("script") == a.script)).agg(F.max_by("resources", F.struct("file", "position")).alias("r")).filter("r is not null")
    asked = maintenance.resource_request(F.col("r.max_rss_bytes"), F.col("r.max_vms_bytes"), F.col("r.wall_seconds"), a.margin)
    millicores = F.ceil(F.col("r.cpu_seconds") / F.greatest(F.col("r.wall_seconds"), F.lit(1e-9)) * a.margin * 1000)
    found = last.select(*(c.alias(n) for n, c in asked.items()), millicores.alias("millicores"))
    one = found.first()
    if a.format == "json":
        _say(found)
    elif one:
        print(rendering.request(one.asDict(), a.format), end="")
    return 0 if one else 2


def _now(spark: SparkSession, names: list[str], root: Path) -> DataFrame:
    """Digests of files now, each read once on the driver's file system."""
    rows = []
    for n in sorted(set(names)):
        try:
            d = describe(root / n)
        except (OSError, ValueError):
            rows.append((n, None, None, None))
            continue
        if d.get("kind") != "missing":
            full = d.get("content_sha256") or d.get("sha256") or d.get("sha256_tree")
            rows.append((n, full[: dg.PIN_CHARS], full, d.get("size_bytes")))
    return spark.createDataFrame(rows, "name string, digest string, whole string, size bigint")


def _pinned(spark: SparkSession, files: list[Path], root: Path) -> tuple[DataFrame, DataFrame]:
    """(statuses of all files, their pinned inputs with a status each)."""
    heads = []
    for f in files:
        with open(f, "rb") as h:
            heads.append((f.as_posix(), h.read(pins.HEAD_BYTES).decode("utf-8", "replace")))
    found = pins.pins_of(spark.createDataFrame(heads, "artifact string, head string"), "artifact", "head").cache()
    firsts = {r.artifact: r for r in found.filter("pin_no = 0").select("artifact", "body_at").collect()}
    bodies = [(k, hashlib.sha256(Path(k).read_bytes()[r.body_at :]).hexdigest()[: dg.PIN_CHARS]) for k, r in firsts.items()]
    pin_rows = found.join(spark.createDataFrame(bodies, "artifact string, body_now string"), "artifact", "left").select("artifact", "pin_no", "declared", F.size("entries").alias("carried"), F.col("fields")["body"].alias("body"), "body_now")
    entries = found.select("artifact", "pin_no", F.explode("entries").alias("e")).select("artifact", "pin_no", "e.name", F.col("e.digest").alias("pinned"))
    now = _now(spark, [r.name for r in entries.select("name").distinct().collect() if not r.name.startswith(("/", "<external>/")) and ".." not in r.name], root)
    checked = verify.check_inputs(entries, now).cache()
    statuses = verify.artifact_status(pin_rows, checked, spark.createDataFrame([(f.as_posix(),) for f in files], "artifact string")).cache()
    return statuses, checked


def verify_(a: argparse.Namespace, spark: SparkSession) -> int:
    root = Path(a.root)
    named = [Path(p) for p in a.paths] or [root]
    absent = [p for p in named if not p.exists()]
    skipped = {".git", ".hg", ".svn", ".venv", "venv", "env", "build", "dist", "node_modules", "site-packages", "__pycache__", ".tox"}
    files = sorted({f for p in named for f in ([p] if p.is_file() else p.rglob("*")) if f.is_file() and not skipped & set(f.parts)})
    statuses, _ = _pinned(spark, files, root)
    _say(statuses.filter(F.col("status") != verify.NO_PIN).orderBy("artifact"))
    report = verify.verify_report(statuses, len(absent))
    _say(report)
    return report.first()["exit_code"]


def chain_(a: argparse.Namespace, spark: SparkSession) -> int:
    rows, _, _ = _runs(spark, a.log)
    linked = chain.links(history.chain_lines(rows), block=F.col("position.block")).cache()
    _say(linked.filter(~F.col("status").isin(chain.HOLDS, chain.HOLDS_TRIVIAL)).select("position", "status").orderBy("position").limit(200))
    found = chain.report(linked)
    _say(found)
    verdicts = {r.verdict for r in found.select("verdict").collect()}
    return 1 if chain.BROKEN in verdicts else 0 if verdicts == {"INTACT"} else 2


def gate(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.emit_policy:
        print(policy_file.emitted(), end="")
        return 0
    if not a.policy:
        raise Missing("a policy is needed")
    try:
        wanted = policy_file.load(a.policy)
    except policy_file.PolicyError as error:
        raise Missing(str(error)) from error
    rows, recs, runs = _runs(spark, a.log)
    names = [r for r, _ in wanted]
    if "inputs_verify" in names:
        paths = [r.path for r in history.io_entries(runs).filter("role = 'input'").select("path").distinct().collect()]
        runs = policy.with_inputs(runs, _now(spark, paths, Path(a.root)).select(F.col("name").alias("path"), F.col("whole").alias("digest")))
    answered = policy.answers(runs, names).cache()
    found = policy.assess(answered, ["rule"]).join(spark.createDataFrame(wanted, "rule string, why string"), "rule", "right").cache()
    _say(found.orderBy("rule"))
    _say(policy.reasons(answered).orderBy("rule", "verdict"))
    outcomes = {r.outcome or "CANNOT_CHECK" for r in found.collect()}
    bad = rows.filter(F.col("parse_state") == history.BAD).count()
    code = 1 if "VIOLATED" in outcomes else 2 if bad or outcomes != {"MET"} else 0
    print(json.dumps(rendering.payload("gate", outcome={0: "MET", 1: "VIOLATED", 2: "CANNOT_CHECK"}[code], rules=len(names), unreadable=bad, unfinished=views.in_flight(history.starts(recs), runs).count())))
    return code


def show(a: argparse.Namespace, spark: SparkSession) -> int:
    _, recs, runs = _runs(spark, a.log)
    if a.target:
        found = _pick(runs, a.target, a.limit)
        _show_as(runs.filter(F.col("address").isin(found)).drop("parameters", "notes", "steps", "terminal_log", "inputs_not_in_pin", "refused_late_inputs"), a.format)
        return 0 if found else 1
    ordered = runs.withColumn("order", F.struct("file", "position"))
    _say(views.project_view(ordered, "script", "order", "started_utc", F.col("status") == "ok", F.col("status").isNotNull() & (F.col("status") != "ok")).orderBy("script"))
    outputs = views.latest(history.io_entries(runs).filter("role = 'output'"), ["path"], ["produced_at", "pos"], "address", "size", "sha256", "content_sha256")
    if a.stale:
        own = F.col("whole") if a.rehash else F.lit(None).cast("string")
        now = _now(spark, [r.path for r in outputs.select("path").collect()], Path(a.root)).select(F.col("name").alias("path"), "size", own.alias("digest"))
        ins = history.io_entries(runs).filter("role = 'input'").select(F.col("address").alias("run"), "path", F.coalesce("content_sha256", "sha256").alias("digest"))
        current = now.unionByName(_now(spark, [r.path for r in ins.select("path").distinct().collect()], Path(a.root)).select(F.col("name").alias("path"), "size", F.col("whole").alias("digest"))).groupBy("path").agg(F.max("size").alias("size"), F.max("digest").alias("digest"))
        states = views.staleness(outputs.select("path", F.col("address").alias("run"), "size", (F.coalesce("content_sha256", "sha256") if a.rehash else F.lit(None).cast("string")).alias("digest")), ins, current).cache()
        _say(states.orderBy("path"))
        _say(states.groupBy("state").agg(F.count("*").alias("n")).orderBy("state"))
        return 1 if a.exit_code and states.filter(F.col("state").isin(views.STALE, views.GONE, views.MODIFIED)).count() else 0
    _say(outputs.orderBy("path"))
    _say(views.in_flight(history.starts(recs), runs).select("run_uid", "script", "started_utc", "host", "pid"))
    return 0


def report(a: argparse.Namespace, spark: SparkSession) -> int:
    path = Path(a.artifact)
    if not path.is_file():
        raise Missing(f"{path} is no file")
    _, _, runs = _runs(spark, a.log)
    outs = history.io_entries(runs).filter("role = 'output'").select(F.col("address").alias("run"), "path", "sha256", F.struct("produced_at", "pos").alias("order"))
    match = reports.find_match(outs, spark.createDataFrame([(a.artifact, sha256_of(path))], "path string, sha256 string")).first()
    run = facts.run_view(runs.filter(F.col("address") == match["run"])).first() if match["run"] else None
    status, inputs = _pinned(spark, [path], Path(a.root))
    one = status.first()
    print(rendering.page(a.artifact, {"run": [match.asDict(), *([run.asDict()] if run else [])], "verdict": [one.asDict()], "inputs": [r.asDict() for r in inputs.orderBy("name").toLocalIterator()]}), end="")
    return 1 if one["status"] in (verify.STALE, verify.GONE, verify.ALTERED) else 0 if one["status"] == verify.OK else 2


def export(a: argparse.Namespace, spark: SparkSession) -> int:
    _, _, runs = _runs(spark, a.log)
    io = history.io_entries(runs).select(F.col("address").alias("run"), "role", "path", F.coalesce("sha256", "content_sha256").alias("digest"), F.monotonically_increasing_id().alias("order"))
    said = runs.select(F.col("address").alias("run"), "script", "started_utc", "finished_utc")
    graph_of = exports.prov_document(said, io) if a.format == "prov" else exports.crate_graph(said, io)
    if a.out:
        atomic_write(Path(a.out), "".join(f"{row}\n" for row in graph_of.toJSON().toLocalIterator()).encode())
    else:
        _say(graph_of)
    return 0


def check(a: argparse.Namespace, spark: SparkSession) -> int:
    root = Path(a.root)
    if not root.is_dir():
        raise Missing(f"{root} is no folder")
    sources = [(p.as_posix(), p.read_text("utf-8", "replace")) for p in sorted(root.rglob("*.py")) if not {".venv", "venv", "site-packages", "build"} & set(p.parts)]
    if not sources:
        raise Missing(f"no sources below {root}")
    found = imports.check(spark.createDataFrame(sources, "path string, text string"), "ledgerline").cache()
    bad = found.filter("flagged or not parses")
    _say(bad.orderBy("path"))
    return 1 if bad.count() else 0


def prune(a: argparse.Namespace, spark: SparkSession) -> int:
    folder = Path(a.root) / "prov" / "running"
    if not folder.is_dir() or not any(folder.glob("*.json")):
        return 0
    seconds = spark.range(1).select(maintenance.parse_seconds(F.lit(a.older_than))).first()[0]
    if seconds is None:
        raise Missing(f"{a.older_than} is no age")
    found = history.markers(spark, folder.resolve().as_uri()).withColumn("age", F.unix_timestamp() - F.unix_timestamp(F.to_timestamp("started_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    alive = [r.pid for r in found.filter(F.col("host") == platform.node()).select("pid").distinct().collect() if r.pid and Path(f"/proc/{r.pid}").exists()]
    plan = found.withColumn("plan", maintenance.prune_plan(F.coalesce(F.col("host") == platform.node(), F.lit(False)) | F.lit(a.other_hosts), F.when(F.col("host") == platform.node(), F.col("pid").isin(alive)).otherwise(F.lit(False)), F.col("age"), seconds)).cache()
    _say(plan.select("file", "plan"))
    trouble = 0
    for row in plan.filter("plan = 'remove'").select("file").collect() if not a.dry_run else ():
        try:
            os.unlink(row.file.removeprefix("file:").replace("///", "/"))
        except OSError:
            trouble = 1
    return trouble


def exec_(a: argparse.Namespace, _: SparkSession | None) -> int:
    if not a.cmd:
        raise Missing("no command")
    with Run(a.name or Path(a.cmd[0]).name, Project(Path(a.root))) as run:
        for p in a.input:
            run.input(p)
        done = subprocess.run(a.cmd, check=False)
        for p in a.output:
            run.output(p)
        run.record["notes"]["exit_code"] = done.returncode
    return done.returncode if done.returncode >= 0 else 128 - done.returncode


def capture(a: argparse.Namespace, _: SparkSession | None) -> int:
    if not Path(a.script).is_file():
        raise Missing(f"no script at {a.script}")
    read, written, argv = set(), set(), sys.argv
    root = Path(a.root).resolve()

    def watch(event: str, args: tuple) -> None:
        if event == "open" and watching and isinstance(args[0], str):
            p = Path(args[0]).resolve()
            if p.is_relative_to(root) and p.suffix not in (".py", ".pyc"):
                (written if isinstance(args[1], str) and set(args[1]) & set("wax+") else read).add(p)

    watching = True
    sys.addaudithook(watch)
    code = 0
    with Run(a.name or Path(a.script).stem, Project(root)) as run:
        sys.argv = [a.script, *a.rest]
        try:
            runpy.run_path(a.script, run_name="__main__")
        except SystemExit as end:
            code = int(end.code or 0) if not isinstance(end.code, str) else 1
        finally:
            sys.argv, watching = argv, False
        for p in sorted(read - written):
            if p.exists():
                run.input(p)
        for p in sorted(written):
            run.output(p)
    return code


COMMANDS = {"log": log, "impact": impact, "diff": diff, "env": env, "resources": resources, "report": report, "check": check, "lineage": lineage_, "show": show, "exec": exec_, "verify": verify_, "chain": chain_, "capture": capture, "export": export, "prune": prune, "gate": gate}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerline", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = {name: sub.add_parser(name) for name in COMMANDS}
    for one in p.values():
        one.add_argument("--log", default="prov/history.jsonl")
        one.add_argument("--root", default=".")
    for flag in ("--script", "--run-id"):
        p["log"].add_argument(flag)
    p["log"].add_argument("--limit", type=int)
    for flag in ("--failed", "--unreadable"):
        p["log"].add_argument(flag, action="store_true")
    p["impact"].add_argument("target")
    p["impact"].add_argument("--depth", type=int)
    p["diff"].add_argument("a")
    p["diff"].add_argument("b", nargs="?")
    p["env"].add_argument("run")
    p["env"].add_argument("--compare", required=True)
    p["resources"].add_argument("script")
    p["resources"].add_argument("--margin", type=float, default=1.5)
    p["resources"].add_argument("--format", choices=("json", "tsv", "slurm", "k8s"), default="json")
    p["report"].add_argument("artifact")
    p["show"].add_argument("target", nargs="?")
    p["show"].add_argument("--limit", type=int, default=1)
    for one in ("log", "show"):
        p[one].add_argument("--format", choices=("jsonl", "yaml"), default="jsonl")
    for flag in ("--stale", "--rehash", "--exit-code"):
        p["show"].add_argument(flag, action="store_true")
    p["exec"].add_argument("--name")
    for flag in ("--input", "--output"):
        p["exec"].add_argument(flag, action="append", default=[])
    p["exec"].add_argument("cmd", nargs="*")
    p["verify"].add_argument("paths", nargs="*")
    p["capture"].add_argument("script")
    p["capture"].add_argument("rest", nargs="*")
    p["capture"].add_argument("--name")
    p["export"].add_argument("--format", choices=("prov", "ro-crate"), default="ro-crate")
    p["export"].add_argument("--out")
    p["prune"].add_argument("--older-than", default="30d")
    p["prune"].add_argument("--other-hosts", action="store_true")
    p["prune"].add_argument("--dry-run", action="store_true")
    p["gate"].add_argument("--policy")
    p["gate"].add_argument("--emit-policy", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command not in ("exec", "capture"):
            spark = spark or _session()
        return COMMANDS[a.command](a, spark)
    except Missing as why:
        print(json.dumps({"cannot_check": str(why)}))
        return 2


if __name__ == "__main__":
    sys.exit(main())
