"""What surrounds a run, policies as files, rendering, pins in JSON, and the command line over a recorded history."""

import json
import subprocess
import time

import pytest

from ledgerline import cli, rendering, surroundings
from ledgerline.recorder import Project, Run, canonical, value_digest
from ledgerline.sources import pins, policy_file


def test_status_lines_are_sorted_into_code_and_other():
    said = " M src/a.py\0?? notes.txt\0R  lib/new.py\0lib/old.py\0x\0 M doc/b.sql\0"
    assert surroundings.classify_status(said) == {"code": ["src/a.py", "lib/new.py", "x", "doc/b.sql"], "other": ["notes.txt"], "outside": []}
    assert surroundings.classify_status(said, ("src", "lib/")) == {"code": ["src/a.py", "lib/new.py", "x"], "other": ["notes.txt"], "outside": ["doc/b.sql"]}


def test_repository_says_what_differs_and_nothing_without_one(tmp_path):
    assert surroundings.repository(tmp_path) == {"git_commit": None, "git_status_captured": False}
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "uv.lock").write_text("locked")
    run("add", ".")
    run("commit", "-qm", "x")
    clean = surroundings.repository(tmp_path)
    assert clean["git_status_captured"] and not clean["git_tree_dirty"] and len(clean["git_commit"]) == 40
    (tmp_path / "a.py").write_text("1")
    (tmp_path / "requirements.txt").write_text("x==1")
    assert surroundings.repository(tmp_path)["git_code_dirty"]
    written = {}
    locks = surroundings.archive_lockfiles(tmp_path, tmp_path / "kept", lambda p, b: written.update({p.name: b}))
    assert [(x["name"], x["archived"]) for x in locks] == [("uv.lock", False), ("requirements.txt", True)] and list(written.values()) == [b"x==1"]


def test_managers_and_conda_packages_by_their_evidence(tmp_path):
    (tmp_path / "conda-meta").mkdir()
    (tmp_path / "conda-meta" / "a.json").write_text('{"name": "a", "version": "1", "build": "h"}')
    (tmp_path / "conda-meta" / "b.json").write_text("{")
    (tmp_path / "pyvenv.cfg").write_text("home = x\nuv = 1\n")
    assert [m["name"] for m in surroundings.managers(tmp_path, {"POETRY_ACTIVE": "1"})] == ["conda", "uv", "poetry"]
    assert surroundings.conda_packages(tmp_path) == ([("a", "1", "h")], 1)


def test_meter_measures_memory_and_says_what_it_can_not():
    m = surroundings.Meter()
    held = bytearray(1 << 20)
    time.sleep(0.01)
    found = m.read()
    assert found["wall_seconds"] >= 0.01 and found["max_rss_bytes"] > len(held) and set(found["unavailable"]) == {k for k, v in found.items() if v is None}


class Loud(str):
    def __str__(self):
        return "other"


class Own:
    def __ledgerline_digest__(self):
        return [1, "a"]


def test_canonical_texts_tell_values_apart_and_subclasses_do_not_speak_for_them():
    values = [None, True, 1, 1.0, "1", b"1", [1], (1,), {"a": 1}, {"a": [1]}, [[1], 2], [[1, 2]], "", [], {}, float("nan"), -0.0]
    assert len({canonical(v) for v in values}) == len(values)
    assert canonical(Loud("x")) == canonical("x") == "s:1:x" and canonical({"b": 1, "a": None}) == "d:2:{s:1:a=n:,s:1:b=i:1}"
    loop: list = []
    loop.append(loop)
    assert value_digest(loop) == "UNDIGESTIBLE:list" and value_digest({1: 2}) == "UNDIGESTIBLE:dict" and value_digest(object()) == "UNDIGESTIBLE:object"
    assert value_digest(Own()) == value_digest([1, "a"])


@pytest.mark.parametrize("bad", ["[]", "{}", '{"rules": []}', '{"rules": [{"rule": "no_such", "why": "x"}]}', '{"rules": [{"rule": "clean_tree", "why": ""}]}', '{"rules": [{"rule": "clean_tree", "why": "x", "more": 1}]}', '{"rules": [{"rule": "clean_tree", "why": "x"}, {"rule": "clean_tree", "why": "y"}]}', '{"rules": [], "rules": []}', "{"])
def test_policies_that_are_not_understood_are_refused(tmp_path, bad):
    (tmp_path / "p.json").write_text(bad)
    with pytest.raises(policy_file.PolicyError):
        policy_file.load(tmp_path / "p.json")


def test_policies_from_toml_and_the_emitted_one(tmp_path):
    (tmp_path / "p.toml").write_text('[[rules]]\nrule = "finished_ok"\nwhy = "because"\n')
    assert policy_file.load(tmp_path / "p.toml") == [("finished_ok", "because")]
    (tmp_path / "all.json").write_text(policy_file.emitted())
    assert len(policy_file.load(tmp_path / "all.json")) == 7


def test_rendering():
    assert rendering.printable("a b\n\x1b[2J‮") == "a b\\n\\x1b[2J\\u202e"
    assert rendering.to_yaml([{"a": 1, "b": ["x", {"c": None}], "d": {}}]) == '-\n  "a": 1\n  "b":\n    - "x"\n    -\n      "c": null\n  "d": {}\n'
    assert rendering.request({"mem_mib": 3, "minutes": None}, "slurm") == "#SBATCH --mem=3M\n"
    assert rendering.request({"h_m_s": "0:00:01", "rss_mib": 2}, "tsv").splitlines()[1] == "0:00:01\t2\t"


def test_a_recorded_run_through_the_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "in.txt").write_text("1\n")
    project = Project(root=tmp_path, heartbeat=0.01)
    for k in range(2):
        with Run("job.py", project, {"k": k}, snapshot=True) as run:
            run.input("in.txt")
            run.output_json("out.json", {"answer": 1, "n": float("inf")})
            with run.open_output("out.txt") as f:
                f.write("body\n")
        run.pin_sidecar("out.txt")
    assert json.loads((tmp_path / "out.json").read_text())["n"] == "Infinity"
    (pin,) = pins.parse((tmp_path / "out.json").read_text())
    assert pin["declared"] == 1 and pin["entries"][0]["name"] == "in.txt"
    last = json.loads((tmp_path / "prov/history.jsonl").read_text().splitlines()[-1])
    assert last["resources"]["max_rss_bytes"] > 0 and last["git_status_captured"] is False and "digest" in last["imported_code"] and last["environment_snapshot"]["managers"] is not None

    def ask(*argv):
        code = cli.main(list(argv), spark)
        return code, capsys.readouterr().out

    assert ask("verify", "out.txt", "out.json")[0] == 0
    assert ask("chain")[0] == 0
    (tmp_path / "p.json").write_text('{"rules": [{"rule": "inputs_verify", "why": "x"}, {"rule": "finished_ok", "why": "y"}]}')
    code, said = ask("gate", "--policy", "p.json")
    assert code == 0 and '"outcome": "MET"' in said
    code, said = ask("report", "out.txt")
    assert code == 0 and "in.txt" in said and "status OK" in said
    assert ask("resources", "job.py", "--format", "slurm")[1].startswith("#SBATCH --mem=")
    code, said = ask("log", "--format", "yaml", "--limit", "1")
    assert code == 0 and said.count('"script": "job.py"') == 1
    (tmp_path / "in.txt").write_text("2\n")
    code, said = ask("gate", "--policy", "p.json")
    assert code == 1 and "an input has changed" in said
    assert ask("report", "out.txt")[0] == 1
    assert ask("show", "--stale", "--rehash", "--exit-code")[0] == 1
    (tmp_path / "p.json").write_text('{"rules": [{"rule": "clean_tree", "why": "x"}]}')
    assert ask("gate", "--policy", "p.json")[0] == 2
    assert ask("gate", "--emit-policy")[0] == 0 and ask("gate", "--policy", "none.json")[0] == 2
