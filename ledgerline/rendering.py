"""Answers as text: YAML of records, printable text, scheduler requests, versioned payloads."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

#: Nesting from which on a value is named and not followed.
DEPTH = 100


def printable(text: str) -> str:
    """A text whose control and format signs are escaped, so that a page can't be rewritten by what it shows."""
    return "".join(c if c.isprintable() else c.encode("unicode_escape", "surrogatepass").decode("ascii") for c in text)


def _scalar(value: Any) -> str:
    return json.dumps(value if isinstance(value, (str, int, float, bool, type(None))) else str(value), ensure_ascii=False)


def _yaml(value: Any, indent: int, depth: int) -> Iterable[str]:
    pad = "  " * indent
    if depth > DEPTH:
        yield f"{pad}{_scalar('<nested too deep>')}"
    elif isinstance(value, dict) and value:
        for k, v in value.items():
            nested = isinstance(v, (dict, list, tuple)) and len(v) > 0
            yield f"{pad}{_scalar(str(k))}:" + ("" if nested else f" {_flat(v)}")
            if nested:
                yield from _yaml(v, indent + 1, depth + 1)
    elif isinstance(value, (list, tuple)) and value:
        for v in value:
            nested = isinstance(v, (dict, list, tuple)) and len(v) > 0
            yield f"{pad}-" + ("" if nested else f" {_flat(v)}")
            if nested:
                yield from _yaml(v, indent + 1, depth + 1)
    else:
        yield f"{pad}{_flat(value)}"


def _flat(value: Any) -> str:
    return "{}" if isinstance(value, dict) else "[]" if isinstance(value, (list, tuple)) else _scalar(value)


def to_yaml(records: Iterable[dict]) -> str:
    """Records as one YAML document: a list, every key and scalar quoted as JSON does."""
    rows = list(records)
    return "\n".join(_yaml(rows, 0, 0)) + "\n" if rows else "[]\n"


def payload(command: str, version: int = 1, **answer: Any) -> dict[str, Any]:
    """The machine-readable answer of a command: its schema first, every key always there."""
    return {"schema": f"ledgerline.{command}.v{version}", **answer}


def request(found: dict[str, Any], kind: str) -> str:
    """A scheduler's lines for what :func:`maintenance.resource_request` asks for; a figure that is not known stays blank."""
    say = lambda key, form: "" if found.get(key) is None else form.format(found[key])
    if kind == "tsv":
        head = ("h_m_s", "rss_mib", "vms_mib")
        return "\t".join(head) + "\n" + "\t".join(say(k, "{}") for k in head) + "\n"
    if kind == "slurm":
        lines = (say("mem_mib", "#SBATCH --mem={}M"), say("minutes", "#SBATCH --time={}"))
    elif kind == "k8s":
        lines = ("resources:", "  requests:", say("mem_mib", '    memory: "{}Mi"'), say("millicores", '    cpu: "{}m"'))
    else:
        raise ValueError(f"no form {kind}")
    return "".join(f"{line}\n" for line in lines if line)


def page(title: str, sections: dict[str, Iterable[dict]]) -> str:
    """A plain page: a title, and under each heading its rows or that there are none."""
    out = [printable(title), "=" * len(title)]
    for heading, rows in sections.items():
        out += ["", printable(heading), "-" * len(heading)]
        shown = [", ".join(f"{k} {printable(str(v))}" for k, v in row.items() if v is not None) for row in rows]
        out += [f"  {row}" for row in shown] or ["  none"]
    return "\n".join(out) + "\n"
