"""What surrounds a run, taken on the driver: its repository, lock files, managers, packages, code and use of memory."""

from __future__ import annotations

import hashlib
import json
import os
import resource
import subprocess
import sys
import threading
import time
from pathlib import Path
from typing import Any

#: Lock files that are known by name.
LOCKFILES = ("uv.lock", "poetry.lock", "pdm.lock", "Pipfile.lock", "pixi.lock", "conda-lock.yml", "environment.yml", "environment.yaml", "requirements.txt", "requirements.lock", "pylock.toml")
#: Files that count as code beside Python's own, by suffix; a line of git's that can't be read counts as code too.
CODE = {".py", ".pyx", ".pyi", ".ipynb", ".r", ".jl", ".sh", ".c", ".cc", ".cpp", ".h", ".rs", ".go", ".java", ".scala", ".sql"}
#: How many imported files a record holds.
IMPORTED = 200


def git(root: Path, *args: str) -> str | None:
    """What git says, or None where it says nothing: no repository, no git, an error or no answer in time."""
    try:
        done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, timeout=30, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "surrogateescape") if done.returncode == 0 else None


def classify_status(text: str, code_paths: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Changed paths of ``git status --porcelain -z``: code, other, and code outside the paths that count."""
    found: dict[str, list[str]] = {"code": [], "other": [], "outside": []}
    fields = iter(text.split("\0"))
    for entry in fields:
        if not entry:
            continue
        if len(entry) < 4 or entry[2] != " ":
            found["code"].append(entry)
            continue
        if entry[0] in "RC":
            next(fields, None)  # where it came from
        path = entry[3:]
        if Path(path).suffix.lower() not in CODE:
            found["other"].append(path)
        elif code_paths and not any(path == c or path.startswith(c.rstrip("/") + "/") for c in code_paths):
            found["outside"].append(path)
        else:
            found["code"].append(path)
    return found


def repository(root: Path, code_paths: tuple[str, ...] = ()) -> dict[str, Any]:
    """The commit and whether anything, or code, differs from it; without an answer nothing is claimed."""
    commit = git(root, "rev-parse", "HEAD")
    said = git(root, "status", "--porcelain", "-z", "--untracked-files=normal") if commit is not None else None
    if said is None:
        return {"git_commit": commit.strip() if commit else None, "git_status_captured": False}
    changed = classify_status(said, code_paths)
    return {"git_commit": commit.strip(), "git_status_captured": True, "git_tree_dirty": any(changed.values()), "git_code_dirty": bool(changed["code"])}


def lockfiles(root: Path) -> list[dict[str, Any]]:
    """The known lock files of a folder with their digests; one that can't be read says why."""
    found = []
    for name in LOCKFILES:
        path = root / name
        if not path.is_file():
            continue
        try:
            body = path.read_bytes()
            found.append({"name": name, "path": name, "sha256": hashlib.sha256(body).hexdigest(), "bytes": len(body)})
        except OSError as error:
            found.append({"name": name, "path": name, "error": str(error)})
    return found


def archive_lockfiles(root: Path, into: Path, write: Any) -> list[dict[str, Any]]:
    """Lock files copied under the names of their digests, unless the repository holds the same bytes already."""
    found = lockfiles(root)
    for lock in found:
        if "sha256" not in lock:
            continue
        body = (root / lock["name"]).read_bytes()
        blob, held = git(root, "hash-object", lock["name"]), git(root, "rev-parse", f"HEAD:{lock['name']}")
        lock["archived"] = not (blob and blob == held)
        target = into / f"{lock['sha256'][:16]}-{lock['name']}"
        if lock["archived"] and not target.exists():
            write(target, body)
    return found


def managers(prefix: Path | None = None, env: dict[str, str] | None = None) -> list[dict[str, str]]:
    """Environment managers that left evidence, and that evidence."""
    prefix, env = prefix or Path(sys.prefix), dict(os.environ if env is None else env)
    found = []
    if (prefix / "conda-meta").is_dir():
        found.append({"name": "conda", "evidence": "conda-meta"})
    config = prefix / "pyvenv.cfg"
    if config.is_file():
        text = config.read_text("utf-8", "replace")
        found.append({"name": "uv" if "\nuv = " in f"\n{text}" else "venv", "evidence": "pyvenv.cfg"})
    for name, variable in (("pixi", "PIXI_PROJECT_NAME"), ("poetry", "POETRY_ACTIVE"), ("pipenv", "PIPENV_ACTIVE"), ("hatch", "HATCH_ENV_ACTIVE")):
        if env.get(variable):
            found.append({"name": name, "evidence": variable})
    return found


def conda_packages(prefix: Path | None = None) -> tuple[list[tuple[str, str, str]], int]:
    """(name, version, build) of what conda has installed, and how many of its records can't be read."""
    found, bad = [], 0
    for path in sorted(((prefix or Path(sys.prefix)) / "conda-meta").glob("*.json")):
        try:
            meta = json.loads(path.read_text("utf-8"))
            found.append((meta["name"], meta["version"], meta.get("build", "")))
        except (OSError, ValueError, KeyError, TypeError):
            bad += 1
    return sorted(found), bad


def imported_code(root: Path) -> dict[str, Any]:
    """Digest over the files below a folder that this process has imported; the first IMPORTED by path are held."""
    root = root.resolve()
    paths = {Path(f).resolve() for f in (getattr(m, "__file__", None) for m in list(sys.modules.values())) if f}
    own = sorted(p.relative_to(root).as_posix() for p in paths if p.is_relative_to(root) and p.suffix == ".py" and "site-packages" not in p.parts and p.is_file())
    lines = [f"{hashlib.sha256((root / p).read_bytes()).hexdigest()}  {p}\n" for p in own[:IMPORTED]]
    return {"count": len(lines), "digest": hashlib.sha256("".join(lines).encode()).hexdigest(), "omitted": max(0, len(own) - IMPORTED)}


def _status_kib(name: str) -> int | None:
    try:
        with open("/proc/self/status") as f:
            return next((int(x.split()[1]) * 1024 for x in f if x.startswith(name + ":")), None)
    except OSError:
        return None


def _cgroup_peak() -> int | None:
    """The peak of this process's own control group; the root group is everybody's and says nothing."""
    try:
        own = next(x.split("::", 1)[1].strip() for x in Path("/proc/self/cgroup").read_text().splitlines() if x.startswith("0::"))
        if own == "/":
            return None
        return int(Path(f"/sys/fs/cgroup{own}/memory.peak").read_text())
    except (OSError, ValueError, StopIteration):
        return None


class Meter:
    """Time, memory and bytes read and written between its start and :meth:`read`."""

    def __init__(self) -> None:
        self.wall, self.cpu, self.io = time.perf_counter(), self._cpu(), self._io()

    @staticmethod
    def _cpu() -> float:
        return sum(u.ru_utime + u.ru_stime for u in map(resource.getrusage, (resource.RUSAGE_SELF, resource.RUSAGE_CHILDREN)))

    @staticmethod
    def _io() -> dict[str, int]:
        try:
            pairs = (x.split(": ") for x in Path("/proc/self/io").read_text().splitlines())
            return {k: int(v) for k, v in pairs if k in ("read_bytes", "write_bytes")}
        except (OSError, ValueError):
            return {}

    def read(self) -> dict[str, Any]:
        """The figures, where they come from, and which are not to be had."""
        peak, io = _cgroup_peak(), self._io()
        own = max(resource.getrusage(w).ru_maxrss for w in (resource.RUSAGE_SELF, resource.RUSAGE_CHILDREN)) * (1 if sys.platform == "darwin" else 1024)
        out: dict[str, Any] = {"wall_seconds": time.perf_counter() - self.wall, "cpu_seconds": self._cpu() - self.cpu, "max_rss_bytes": peak or own, "max_vms_bytes": _status_kib("VmPeak"), "source": "cgroup" if peak else "getrusage"}
        for name in ("read", "write"):
            out[f"io_{name}_bytes"] = io[f"{name}_bytes"] - self.io[f"{name}_bytes"] if f"{name}_bytes" in io and f"{name}_bytes" in self.io else None
        out["io_self_only"] = True
        out["unavailable"] = sorted(k for k, v in out.items() if v is None)
        return out


class Heartbeat:
    """Touches a marker at intervals while a run goes on; a stale one tells that the run is not alive."""

    def __init__(self, marker: Path, seconds: float) -> None:
        self.marker, self.seconds, self.over = marker, seconds, threading.Event()
        self.thread = threading.Thread(target=self._beat, daemon=True)

    def _beat(self) -> None:
        while not self.over.wait(self.seconds):
            try:
                os.utime(self.marker)
            except OSError:
                return

    def __enter__(self) -> Heartbeat:
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        self.thread.join()
