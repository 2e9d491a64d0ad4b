"""A static look at source trees: which entry points open files without reaching the recorder?"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.graph import walk

#: Fixed value: names whose call opens a file.
OPENERS = frozenset({"open", "read_csv", "read_table", "read_parquet", "read_excel", "to_csv", "to_parquet", "savefig", "loadtxt", "savetxt", "load", "save", "dump"})


def facts_of(text: str, stem: str) -> tuple[bool, bool, bool, list[str]]:
    """Whether a module parses, is an entry point and opens files, and what it imports."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return False, False, False, []
    entry = any(isinstance(n, ast.If) and isinstance(n.test, ast.Compare) and any(isinstance(x, ast.Name) and x.id == "__name__" for x in ast.walk(n.test)) for n in tree.body)
    called = {n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))}
    names: set[str] = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            names |= {part for a in n.names for part in a.name.split(".")}
        elif isinstance(n, ast.ImportFrom):
            names |= {*(n.module or "").split("."), *(a.name for a in n.names)}
    return True, entry, bool(called & OPENERS), sorted(names - {"", stem})


def facts(sources: DataFrame) -> DataFrame:
    """(path, stem, parses, entry, opens, imports) of sources (path, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            stems = [p.rsplit("/", 1)[-1].removesuffix(".py") for p in paths]
            found = [facts_of(t or "", s) for t, s in zip(batch.column("text").to_pylist(), stems, strict=True)]
            cols = [pa.array(paths), pa.array(stems), *(pa.array([f[k] for f in found], pa.bool_()) for k in range(3)), pa.array([f[3] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "stem", "parses", "entry", "opens", "imports"])

    return sources.select("path", "text").mapInArrow(each, "path string, stem string, parses boolean, entry boolean, opens boolean, imports array<string>")


def check(sources: DataFrame, recorder: str) -> DataFrame:
    """(path, parses, entry, opens, reaches, flagged): flagged entry points open files and don't reach the recorder, directly or through modules of the tree."""
    known = facts(sources)
    edges = known.select(F.col("stem").alias("dst"), F.explode("imports").alias("src"))
    # from the recorder back to the modules that import it
    reached = walk(edges, sources.sparkSession.createDataFrame([(recorder,)], "node string")).select(F.col("node").alias("stem"), F.lit(True).alias("reaches"))
    out = known.join(reached, "stem", "left").withColumn("reaches", F.coalesce("reaches", F.lit(False)))
    return out.select("path", "parses", "entry", "opens", "reaches", (F.col("entry") & F.col("opens") & ~F.col("reaches")).alias("flagged"))
