"""Single facts of runs: what a page shows of them, what moved since, what was imported and called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.digest import PIN_CHARS


def status_of(status: Column) -> Column:
    """The recorded status; what is missing or empty is unknown and never taken for ok."""
    return F.coalesce(F.nullif(status, F.lit("")), F.lit("unknown"))


def run_view(runs: DataFrame) -> DataFrame:
    """One flat row for each completed run; what a record does not say is shown as a question mark."""
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?"))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    return runs.select("address", shown("script").alias("script"), status_of(F.col("status")).alias("status"), shown("started_utc").alias("started"), shown("finished_utc").alias("finished"), shown("git_commit").alias("commit"), size("inputs").alias("n_inputs"), size("outputs").alias("n_outputs"))


def recorded_pair(content: Column, raw: Column, tree: Column) -> tuple[Column, Column]:
    """The best digest of an entry and the key that it stands under, both null where there is none."""
    keyed = (("content_sha256", content), ("sha256", raw), ("sha256_tree", tree))
    held = [(name, F.nullif(value, F.lit(""))) for name, value in keyed]
    return F.coalesce(*(v for _, v in held)), F.coalesce(*(F.when(v.isNotNull(), name) for name, v in held))


def displayed(digest: Column) -> Column:
    """A digest as text pages show it."""
    return F.left(digest, F.lit(PIN_CHARS))


def shortened(path: Column, root: Column) -> Column:
    """A path relative to the root where it lies below it."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def posix(path: Column) -> Column:
    """A path in one spelling."""
    return F.translate(path, "\\", "/")


def resolved(path: Column, cwd: Column) -> Column:
    """A recorded path, anchored where its run stood; absolute paths and unknown places stay as they are."""
    plain = posix(path)
    anchored = F.concat(F.regexp_replace(posix(cwd), "/+$", ""), F.lit("/"), F.regexp_replace(plain, r"^(\./)+", ""))
    return F.when(F.startswith(plain, F.lit("/")) | cwd.isNull(), plain).otherwise(anchored)


def moved_since(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(run, path, moved) of recorded files: gone, size, mtime, or null where nothing moved or nothing was recorded.

    ``recorded``: run, path, cwd, kind, size, mtime; ``current``: path, size, mtime, each path once.
    Only files are looked at (an entry without a kind is one), and only where a size is recorded.
    """
    now = current.select(F.col("path").alias("at"), F.col("size").alias("now_size"), F.col("mtime").alias("now_mtime"), F.lit(True).alias("there"))
    asked = recorded.withColumn("at", resolved(F.col("path"), F.col("cwd")))
    asks = (F.coalesce("kind", F.lit("file")) == "file") & F.col("size").isNotNull()
    moved = F.when(~asks, None).when(F.col("there").isNull(), "gone").when(F.col("size") != F.col("now_size"), "size").when(F.col("mtime") != F.col("now_mtime"), "mtime")
    return asked.join(now, "at", "left").select("run", "path", moved.alias("moved"))


def imported_code(files: DataFrame, run: str, path: str, digest: str, limit: int = 200) -> DataFrame:
    """(run, count, digest, omitted): sha256 over the sorted lines of digest and path of a run's first files.

    The record holds ``limit`` files by definition; the rest is counted. Only that many are
    gathered for a run.
    """
    rank = F.row_number().over(Window.partitionBy(run).orderBy(path, digest))
    line = F.concat(F.col(digest), F.lit("  "), F.col(path), F.lit("\n"))
    ranked = files.select(run, line.alias("line"), rank.alias("n"))
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= limit, F.struct("n", "line")))), lambda e: e["line"]), "")
    return ranked.groupBy(run).agg(F.least(F.count("*"), F.lit(limit)).alias("count"), F.sha2(held.cast("binary"), 256).alias("digest"), F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))


def census(calls: DataFrame, function: str, signature: str, functions: int = 200, signatures: int = 32) -> DataFrame:
    """(function, calls, signature, n): the most called functions and each one's most frequent signatures.

    The census shows so many by definition; ``calls`` counts all calls of a function.
    """
    each = calls.groupBy(F.col(function).alias("function"), F.col(signature).alias("signature")).agg(F.count("*").alias("n"))
    top = each.groupBy("function").agg(F.sum("n").alias("calls")).orderBy(F.desc("calls"), "function").limit(functions)
    rank = F.row_number().over(Window.partitionBy("function").orderBy(F.desc("n"), "signature"))
    return each.join(F.broadcast(top), "function").withColumn("rank", rank).filter(F.col("rank") <= signatures).select("function", "calls", "signature", "n")
