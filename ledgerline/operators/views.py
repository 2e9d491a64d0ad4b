"""Views of a history: by script, latest writers, selections, tails, what is still running."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRESH, STALE, GONE, MODIFIED, UNKNOWN = "FRESH", "STALE", "GONE", "MODIFIED", "UNKNOWN"


def project_view(runs: DataFrame, script: str, order: str, started: str, ok: Column, failed: Column, **sets: str) -> DataFrame:
    """Per script: runs, ok, failed (neither where the status is unknown), first and last start in file order, and sorted distinct values of ``sets``."""
    collected = [F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()]
    return runs.groupBy(script).agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("ok"), F.count_if(failed).alias("failed"), F.min_by(started, order).alias("first_started"), F.max_by(started, order).alias("last_started"), *collected
    )


def script_values(runs: DataFrame) -> DataFrame:
    """(script, kind, value), each once: paths read and written, names of parameters and notes of each script.

    One row for each value, so that a script that touches very many paths is no one row.
    """
    keys = lambda c: F.coalesce(F.json_object_keys(F.to_json(c)), F.expr("cast(array() as array<string>)"))
    paths = lambda c: F.coalesce(F.transform(c, lambda e: e["path"]), F.expr("cast(array() as array<string>)"))
    named = F.map_from_arrays(F.array(*map(F.lit, ("input", "output", "parameter", "note"))), F.array(paths("inputs"), paths("outputs"), keys("parameters"), keys("notes")))
    each = runs.select("script", F.explode(named).alias("kind", "values"))
    return each.select("script", "kind", F.explode("values").alias("value")).distinct()


def latest(rows: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """Per key the values of the row that is last in ``order``, combined before the shuffle."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"last.{v}").alias(v) for v in values))


def with_next(rows: DataFrame, key: str, order: str, value: str, into: str, block: int = 1 << 17) -> DataFrame:
    """Rows with the value of the next row of their key in the order of a whole number; null for the last.

    Numbers are cut into blocks, so that a key with very many rows is walked by many tasks;
    what a block needs of those after it is their first row. ``rows`` are asked twice.
    """
    one = F.struct(F.col(value).alias("v"))
    blocked = rows.withColumn("__block", F.floor(F.col(order) / block))
    first = blocked.groupBy(F.col(key).alias("__key"), F.col("__block").alias("__of")).agg(F.min_by(one, order).alias("__first"))
    after = first.withColumn("__after", F.lead("__first").over(Window.partitionBy("__key").orderBy("__of"))).drop("__first")
    own = blocked.withColumn("__next", F.lead(one).over(Window.partitionBy(key, "__block").orderBy(order)))
    out = own.join(after, F.col(key).eqNullSafe(F.col("__key")) & F.col("__block").eqNullSafe(F.col("__of")))
    return out.withColumn(into, F.coalesce("__next", "__after")["v"]).drop("__block", "__key", "__of", "__after", "__next")


def select_runs(runs: DataFrame, bucket: Column, order: str, limit: int) -> DataFrame:
    """The last ``limit`` runs of the best bucket that holds any, with ``matching``, their number before the limit.

    ``bucket`` is the number of the first way in which a run matches, null for none. The
    best bucket is found by one aggregate, the last runs by a top-k.
    """
    marked = runs.withColumn("bucket", bucket).filter("bucket is not null")
    best = marked.groupBy("bucket").agg(F.count("*").alias("matching")).orderBy("bucket").limit(1)  # a row for each way to match
    return marked.join(F.broadcast(best), "bucket").orderBy(F.col(order).desc()).limit(limit)


def tail(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """The last rows, in order: a top-k and a sort of what it leaves."""
    return rows.orderBy(F.col(order).desc()).limit(limit).orderBy(order)


def log_counters(runs: DataFrame, matches: Column, failed: Column, limit: int | None = None) -> DataFrame:
    """One row: total, matching, failed (of the matching), shown, and whether a named filter hit anything."""
    hit = F.coalesce(matches, F.lit(False))
    counted = runs.agg(F.count("*").alias("total"), F.count_if(hit).alias("matching"), F.count_if(hit & failed).alias("failed"))
    shown = F.least("matching", F.lit(limit)) if limit is not None else F.col("matching")
    return counted.withColumn("shown", shown.cast("bigint")).withColumn("matched_any", F.col("matching") > 0)


def in_flight(starts: DataFrame, completed: DataFrame, key: str = "run_uid") -> DataFrame:
    """Runs that began and have not ended: an anti join. A start without a key can't be told to have ended."""
    return starts.join(completed.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def with_markers(open_runs: DataFrame, markers: DataFrame, key: str = "run_uid") -> DataFrame:
    """Open runs with their markers, and markers of runs of which the history knows no start."""
    m = markers.select(key, *(F.col(c).alias(f"marker_{c}") for c in markers.columns if c != key), F.lit(True).alias("marked"))
    return open_runs.withColumn("in_history", F.lit(True)).join(m, key, "full_outer").fillna(False, ["in_history", "marked"])


def staleness(outputs: DataFrame, inputs: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state) of each output's latest writer.

    ``outputs``: path, run, size, digest; ``inputs``: run, path, digest; ``current``: path, size,
    digest (null where it was not taken). GONE if the output is not there, MODIFIED if it is
    not what was written, STALE if an input moved, UNKNOWN if nothing says, else FRESH.
    """
    now = current.select("path", F.col("size").alias("now_size"), F.col("digest").alias("now_digest"), F.lit(True).alias("there"))
    moved = F.when(F.col("there").isNull(), STALE).when(F.col("digest").isNull() | F.col("now_digest").isNull(), UNKNOWN).when(F.col("digest") != F.col("now_digest"), STALE).otherwise(FRESH)
    by_run = inputs.join(now, "path", "left").groupBy("run").agg(F.count_if(moved == STALE).alias("stale"), F.count_if(moved == UNKNOWN).alias("unknown"), F.count("*").alias("n"))
    own = outputs.join(now, "path", "left").join(by_run, "run", "left")
    changed = (F.col("size") != F.col("now_size")) | (F.col("digest") != F.col("now_digest"))
    state = F.when(F.col("there").isNull(), GONE).when(F.coalesce(changed, F.lit(False)), MODIFIED).when(F.col("stale") > 0, STALE).when(F.col("n").isNull() | (F.col("unknown") > 0), UNKNOWN).otherwise(FRESH)
    return own.select("path", "run", state.alias("state"))


def unregistered(opened: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """What was opened and not registered, once each."""
    return opened.select(key).distinct().join(registered.select(key), key, "left_anti")


def ranked_last(rows: DataFrame, by: list[str], order: str, limit: int) -> DataFrame:
    """The last ``limit`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limit).drop("__n")
