"""Policies from JSON or TOML files, read strictly: what is not understood is refused."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from ledgerline.operators.policy import RULES


class PolicyError(ValueError):
    """A policy that can't be applied as it stands."""


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise PolicyError("a key stands twice")
    return out


def load(path: str | Path) -> list[tuple[str, str]]:
    """(rule, why) of each rule, in order. TOML by its suffix, JSON otherwise."""
    path = Path(path)
    try:
        text = path.read_text("utf-8")
    except (OSError, UnicodeDecodeError) as error:
        raise PolicyError(f"{path} can't be read: {error}") from error
    try:
        if path.suffix.lower() == ".toml":
            import tomllib

            found: Any = tomllib.loads(text)
        else:
            found = json.loads(text, object_pairs_hook=_once)
    except PolicyError:
        raise
    except ValueError as error:
        raise PolicyError(f"{path} is not well formed: {error}") from error
    return checked(found)


def checked(found: Any) -> list[tuple[str, str]]:
    """The rules of a policy, or PolicyError that says what is wrong with it."""
    if not isinstance(found, dict) or set(found) != {"rules"} or not isinstance(found["rules"], list):
        raise PolicyError("a policy is an object whose one key is rules, a list")
    out: list[tuple[str, str]] = []
    for one in found["rules"]:
        if not isinstance(one, dict) or set(one) != {"rule", "why"} or not all(isinstance(v, str) and v.strip() for v in one.values()):
            raise PolicyError("each rule has a name and a reason, and nothing else")
        if one["rule"] not in RULES:
            raise PolicyError(f"there is no rule {one['rule']}")
        if one["rule"] in (r for r, _ in out):
            raise PolicyError(f"rule {one['rule']} stands twice")
        out.append((one["rule"], one["why"]))
    if not out:
        raise PolicyError("a policy without rules can't be met")
    return out


def emitted() -> str:
    """A policy of all rules, to start from."""
    return json.dumps({"rules": [{"rule": r.name, "why": r.asks} for r in RULES.values()]}, indent=2) + "\n"
