"""Histories written by the recorder and by hand, through every question."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline import cli, recorder
from ledgerline.operators import chain, lineage, policy, reports
from ledgerline.sources import history


@pytest.fixture
def project(tmp_path, monkeypatch):
    """Three recorded runs: align reads two files, genotype reads align's output, summarise reads genotype's."""
    monkeypatch.chdir(tmp_path)
    (tmp_path / "data").mkdir()
    (tmp_path / "data/m.tsv").write_text("a\t1\n")
    (tmp_path / "data/refs").mkdir()
    (tmp_path / "data/refs/x.fa").write_text("ACGT")
    p = recorder.Project(tmp_path)
    steps = [("align", ["data/refs", "data/m.tsv"]), ("genotype", ["out/align.tsv"]), ("summarise", ["out/genotype.tsv"])]
    for k, (name, inputs) in enumerate(steps):
        with recorder.Run(name, p, {"k": k}) as run:
            for i in inputs:
                run.input(i)
            with run.open_output(f"out/{name}.tsv") as f:
                f.write(f"{name}\t{k}\n")
    return tmp_path


def read(spark, path):
    rows = history.parsed(history.lines(spark, str(path)))
    return rows, history.completed(history.records(rows))


def test_lineage_chain_and_policy_of_recorded_runs(spark, project):
    rows, runs = read(spark, project / "prov/history.jsonl")
    names = {r.address: r.script for r in runs.collect()}
    found = lineage.resolve(*history.lineage_sides(history.io_entries(runs)))
    assert {(names[e.src], names[e.dst]) for e in lineage.edges(found).collect()} == {("align", "genotype"), ("genotype", "summarise")}
    assert lineage.counts(found).first().asDict() == {"inputs": 4, "resolvable": 2, "unsequenced": 0, "orphan": 2, "ambiguous": 0}
    row = chain.report(chain.links(history.chain_lines(rows).withColumn("version", F.lit("1.0.0")))).first()
    assert (row.lines, row.attested, row.verdict) == (6, 5, "INTACT")
    got = {r.rule: r.outcome for r in policy.assess(policy.answers(runs), ["rule"]).collect()}
    assert got["finished_ok"] == got["outputs_pin_inputs"] == "MET" and got["environment_captured"] == "VIOLATED" and got["clean_tree"] == "CANNOT_CHECK"


def test_damage_is_counted_and_told_apart(spark, project, tmp_path):
    good = (project / "prov/history.jsonl").read_bytes().split(b"\n")[:-1]
    numbers = iter(range(99))

    def verdict(lines):
        damaged = tmp_path / f"damaged{next(numbers)}.jsonl"
        damaged.write_bytes(b"\n".join(lines) + b"\n")
        rows = history.parsed(history.lines(spark, str(damaged))).cache()
        states = [r.parse_state for r in rows.orderBy("position").collect()]
        linked = chain.links(history.chain_lines(rows).withColumn("version", F.lit("1.0.0")))
        return states.count("bad"), chain.report(linked).first().verdict

    assert verdict(good) == (0, "INTACT")
    assert verdict([*good[:2], good[2].replace(b'"genotype"', b'"genotypf"'), *good[3:]]) == (0, "BROKEN")
    assert verdict([*good[:2], *good[3:]]) == (0, "BROKEN")
    assert verdict([good[1], good[0], *good[2:]]) == (0, "BROKEN")
    assert verdict([x + b"\r" for x in good])[1] == "CANNOT_CHECK"
    assert verdict([*good, b"[1,2]", b"123", b"null", b"\xff\xfe", b'{"torn": '])[0] == 5
    assert verdict([*good[:2], good[2] + good[3], *good[4:]]) == (1, "CANNOT_CHECK")


def test_every_command_answers_with_its_exit_code(spark, project, capsys):
    run = lambda *argv: cli.main(list(argv), spark)
    assert run("log") == 0 and run("log", "--script", "nobody") == 1 and run("log", "--log", "nowhere") == 2
    assert run("lineage") == 0 and run("verify", "out") == 0 and run("show") == 0 and run("show", "nobody") == 1 and run("show", "--stale", "--exit-code") == 0
    assert run("impact", "data/m.tsv") == 1 and run("impact", "out/summarise.tsv") == 0 and run("impact", "nothing") == 2
    assert run("diff", "align", "genotype") == 1 and run("diff", "align") == 2
    assert run("resources", "align") == 0 and run("resources", "nobody") == 2
    assert run("report", "out/align.tsv") == 0 and run("export", "--format", "prov") == 0 and run("export") == 0
    assert run("prune", "--older-than", "30d") == 0 and run("env", "align", "--compare", "genotype") == 2
    (project / "p.json").write_text(json.dumps({"rules": [{"rule": "finished_ok", "why": "always"}]}))
    assert run("gate", "--policy", "p.json") == 0
    (project / "p.json").write_text(json.dumps({"rules": [{"rule": "clean_tree", "why": "always"}]}))
    assert run("gate", "--policy", "p.json") == 2
    assert run("exec", "--name", "e", "--", "true") == 0 and run("exec", "--", "false") == 1
    (project / "s.py").write_text("import sys\nopen('made.txt', 'w').write(open('data/m.tsv').read())\nif __name__ == '__main__':\n    open('x.txt', 'w')\n")
    assert run("capture", "s.py") == 0 and run("check") == 1
    last = json.loads((project / "prov/history.jsonl").read_text().splitlines()[-1])
    assert last["script"] == "s" and [e["path"] for e in last["inputs"]] == [str(project / "data/m.tsv")]
    (project / "data/m.tsv").write_text("a\t2\n")
    assert run("verify", "out") == 1 and run("show", "--stale", "--exit-code") == 1
    (project / "data/m.tsv").unlink()
    assert run("verify", "out") == 1
    assert "cannot_check" in capsys.readouterr().out


def test_altered_bodies_and_missing_pins(spark, project):
    assert cli.main(["verify", "out"], spark) == 0
    body = (project / "out/align.tsv").read_bytes()
    (project / "out/align.tsv").write_bytes(body + b"more\n")
    assert cli.main(["verify", "out/align.tsv"], spark) == 1
    (project / "plain.txt").write_text("no pin")
    assert cli.main(["verify", "plain.txt"], spark) == 2 and cli.main(["verify", "absent"], spark) == 2


def test_runs_of_another_version_join_by_raw_digest(spark, tmp_path):
    d = hashlib.sha256(b"x").hexdigest()
    made = {"schema": "any.history.v2", "script": "a", "run_uid": "u1", "started_utc": "2026-01-01T00:00:00Z", "finished_utc": "2026-01-01T00:00:05Z", "outputs": [{"path": "f", "sha256": d, "content_sha256": "0" * 64}]}
    used = {"schema": "any.run.v1", "script": "b", "started_utc": "2026-01-01T00:00:05Z", "provenance_path": "p", "inputs": [{"path": "f", "sha256": d}, {"path": "f", "sha256": d}, {"path": "g"}]}
    early = dict(used, script="c", started_utc="2026-01-01T00:00:04Z")
    (tmp_path / "h.jsonl").write_text("\n".join(map(json.dumps, [made, used, early])))
    _, runs = read(spark, tmp_path / "h.jsonl")
    found = lineage.resolve(*history.lineage_sides(history.io_entries(runs)))
    assert lineage.counts(found).first().asDict() == {"inputs": 6, "resolvable": 2, "unsequenced": 2, "orphan": 4, "ambiguous": 0}
    assert {e.dst for e in lineage.edges(found).collect()} == {"derived:b|2026-01-01T00:00:05Z|p"}


def test_diff_of_two_runs_tells_differences_from_what_is_not_known(spark, project):
    _, runs = read(spark, project / "prov/history.jsonl")
    a, b = (r.address for r in runs.filter(F.col("script").isin("align", "genotype")).orderBy("position").collect())
    got = {r.dimension: r.verdict for r in reports.diff_runs(runs, a, b).collect()}
    assert got["inputs"] == got["outputs"] == got["parameters"] == "CHANGED" and got["code"] == "NOT_COMPARABLE" and got["status"] == "SAME" and len(got) == 8
    same = {r.dimension: r.verdict for r in reports.diff_runs(runs, a, a).collect()}
    assert "CHANGED" not in same.values()


@pytest.mark.parametrize("cut", [1, 3, 7, 1000])
def test_chains_cut_into_blocks_are_those_walked_whole(spark, cut):
    rng = random.Random(cut)
    rows, before = [], None
    for c in ("a", "b", None):
        for k in range(60):
            own = f"{c}{k}"
            claim = rng.choice([None, "GENESIS", before, before, before, "other"])
            rows.append((c, k, own, f"{own}-cr" if rng.random() < 0.2 else None, claim, rng.random() < 0.8, rng.choice([None, "0.5.0", "0.6.1"])))
            before = rng.choice([own, f"{own}-cr"])
    df = spark.createDataFrame(rows, "chain string, position int, digest string, digest_without_cr string, claim string, readable boolean, version string")
    of = lambda found: sorted((str(r.chain), r.position, r.before, r.started, r.translated, r.status) for r in found.collect())
    got = of(chain.links(df, block=F.floor(F.col("position") / cut)))
    assert len(got) == len(rows) and got == of(chain.links(df))


def test_running_producers_by_stripes_equal_brute_force(spark):
    rng = random.Random(9)
    made = [(f"p{k}", rng.choice(["hot", "hot", "x", "y"]), rng.randrange(300)) for k in range(400)]
    read = [(k, f"c{k}", rng.choice(["hot", "x", "none", None]), rng.randrange(300)) for k in range(400)]
    p, c = spark.createDataFrame(made, "src string, digest string, at int"), spark.createDataFrame(read, "input int, dst string, digest string, at int")
    for stripes in (1, 5, 64):
        got = {r.input: (r.src, r["class"]) for r in lineage.resolve_ordered(p, c, stripes).collect()}
        for k, _, d, at in read:
            some = [(t, s) for s, e, t in made if e == d]
            best = max(((t, s) for t, s in some if t <= at), default=None)
            assert got[k] == (best[1] if best else None, "resolvable" if best else "unsequenced" if some else "orphan")


@pytest.mark.parametrize("stripes", [4, 64, 100_000])
def test_latest_producers_of_shared_digests_equal_brute_force(spark, stripes):
    rng = random.Random(stripes)
    runs = [f"r{k}" for k in range(12)]
    made = [(rng.choice([*runs, None]), rng.choice(["hot", "hot", "x", "y", None]), rng.choice([None, *range(40)])) for _ in range(500)]
    read = [(k, rng.choice([*runs, "c", None]), d, rng.choice([None, *range(40)])) for k in range(300) for d in rng.choice([["hot"], ["x", "hot"], ["y", "x"], ["none"], [None]])]
    at = {(k, dst): t for k, dst, _, t in read}
    dst = {k: d for k, d, _, _ in read}
    read = [(k, dst[k], d, at[k, dst[k]]) for k, _, d, _ in read if (k, dst[k]) in at]
    p, c = spark.createDataFrame(made, "src string, digest string, at int"), spark.createDataFrame(read, "input int, dst string, digest string, at int")
    got = {r.input: (r.src, r["class"]) for r in lineage.resolve(p, c, stripes).collect()}
    assert set(got) == set(dst)
    for k in dst:
        some = [(t, s) for s, e, t in made for i, d, digest, _ in read if i == k and digest is not None and e == digest and None not in (s, d) and s != d]
        now = next(t for i, _, _, t in read if i == k)
        best = max(((t, s) for t, s in some if t is not None and now is not None and t <= now), default=None)
        assert got[k] == (best[1] if best else None, "resolvable" if best else "unsequenced" if some else "orphan")


def test_no_producer_is_paired_with_a_consumer(spark):
    """Crowds of 30,000 producers and 30,000 consumers of one digest, whose pairs nobody could store."""
    p = spark.range(30_000).selectExpr("'r' || id as src", "'d' as digest", "id as at")
    c = spark.range(30_000).selectExpr("id as input", "'r' || id as dst", "'d' as digest", "id as at")
    found = lineage.resolve(p, c)
    assert found.groupBy("class").count().orderBy("class").collect() == [("resolvable", 29_999), ("unsequenced", 1)]
    assert found.filter("class = 'resolvable' and src <> 'r' || (input - 1)").count() == 0
    assert "p.digest" not in found._jdf.queryExecution().optimizedPlan().toString() and found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1
