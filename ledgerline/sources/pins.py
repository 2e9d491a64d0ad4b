"""Pins: the header of an artifact that says what it was made from."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the pin's grammar: how far into a file it may stand, the line it opens with, and its lines.
HEAD_BYTES, FIRST_LINES = 1 << 16, 4
ANCHOR = "provenance — this artifact and what produced it"
NONE = "  inputs     : NONE REGISTERED"
_ENTRY = re.compile(r"^ {4}([0-9a-f]{16}|MISSING) {2}(.+)$")
_COUNT = re.compile(r"^ {2}inputs \((\d+)\), (?:sha256|content digest):$")
_FIELD = re.compile(r"^ {2}(\w+) +: (.*)$")

#: The key under which a JSON file carries its pin, as a list of the pin's lines.
JSON_KEY = "provenance"
_JSON_LINES = re.compile(rf'"{JSON_KEY}"\s*:\s*(\[[^\]]*\])')

PIN_TYPE = "fields map<string,string>, declared int, entries array<struct<digest:string,name:string>>, body_at int"


def parse(head: str) -> list[dict]:
    """All pins of a file's head; none unless the first opens within FIRST_LINES lines."""
    if head.lstrip().startswith("{"):
        return _json_pin(head)
    kept = head.split("\n")
    lines, found, k = [x.rstrip("\r") for x in kept], [], 0
    while k < len(lines):
        at = lines[k].find(ANCHOR)
        if at < 0:
            k += 1
            continue
        if not found and k >= FIRST_LINES:
            break
        marker = lines[k][:at].rstrip(" ")
        pin = {"fields": {}, "declared": None, "entries": []}
        k += 1
        while k < len(lines) and lines[k].startswith(marker) and (pin["declared"] is None or len(pin["entries"]) < pin["declared"]):
            body = lines[k][len(marker) :]
            body = body[1:] if body.startswith(" ") and marker else body
            if body == NONE:
                pin["declared"] = 0
            elif m := _COUNT.match(body):
                pin["declared"] = int(m[1])
            elif (m := _ENTRY.match(body)) and pin["declared"] is not None:
                pin["entries"].append({"digest": m[1], "name": m[2]})
            elif m := _FIELD.match(body):
                pin["fields"][m[1]] = m[2]
            else:
                break
            k += 1
        found.append(pin | {"body_at": len("\n".join(kept[:k]).encode()) + (k < len(kept))})
    return found


def _json_pin(head: str) -> list[dict]:
    """The pin that a JSON object carries; what it covers can't be told from its text, so it has no body."""
    found = _JSON_LINES.search(head)
    try:
        lines = json.loads(found[1]) if found else []
    except ValueError:
        return []
    if not lines or not all(isinstance(x, str) for x in lines):
        return []
    return [pin | {"body_at": 0} for pin in parse("\n".join([*(x.strip("\n") for x in lines), ""]))[:1]]


def pins_of(heads: DataFrame, key: str, head: str, keep: list[str] = ()) -> DataFrame:
    """(key, keep..., pin_no, fields, declared, entries, body_at): a row for each pin; none for files without. body_at is the byte at which what follows the pin begins."""
    names = [key, *keep]
    schema = ", ".join(f"{c} {t}" for c, t in heads.select(*names).dtypes) + ", pin_no int, " + PIN_TYPE
    types = {"fields": pa.map_(pa.string(), pa.string()), "declared": pa.int32(), "entries": pa.list_(pa.struct([("digest", pa.string()), ("name", pa.string())])), "body_at": pa.int32()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pins = [], []
            for k, text in enumerate(batch.column(head).to_pylist()):
                for n, pin in enumerate(parse(text or "")):
                    rows.append(k)
                    pins.append((n, pin))
            at = pa.array(rows, pa.int64())
            cols = [*(batch.column(c).take(at) for c in names), pa.array([n for n, _ in pins], pa.int32())]
            cols += [pa.array([list(p[c].items()) if c == "fields" else p[c] for _, p in pins], t) for c, t in types.items()]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "pin_no", *types])

    return heads.select(*names, head).mapInArrow(each, schema)


def artifact_heads(files: DataFrame) -> DataFrame:
    """(path, head) of rows of the binaryFile source: the text at a file's beginning, read by substring."""
    return files.select("path", F.substring("content", 1, HEAD_BYTES).cast("string").alias("head"))
