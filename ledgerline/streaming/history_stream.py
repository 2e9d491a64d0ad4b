"""Histories as streams: an extension beyond the batch questions.

New lines of a folder of histories flow into a table of runs; begun runs are paired
with completed ones by key, and a run that is not completed in time is reported once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.sources.history import completed, is_start, parsed, records


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of the files of a folder as they come, in the shape that history.parsed takes."""
    rows = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.lit(0).cast("bigint").alias("row")).alias("position"), F.col("value").alias("raw"))


def into_table(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append completed runs to a Parquet table, batch by batch; a batch that is run again is written once."""

    def write(batch: DataFrame, number: int) -> None:
        runs = completed(records(parsed(batch))).drop("parameters", "notes", "steps", "terminal_log", "inputs_not_in_pin", "refused_late_inputs")
        runs.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_script(stream: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Runs and failures of each script in windows of their end, late records allowed for."""
    runs = completed(records(parsed(stream))).select("script", "status", F.to_timestamp("finished_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ended"))
    return runs.withWatermark("ended", late).groupBy(F.window("ended", width), "script").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"))


def open_runs(stream: DataFrame, seconds: int) -> DataFrame:
    """(run_uid, state, script) of runs: completed when both lines are seen, interrupted ``seconds`` after a lone start."""
    rows = records(parsed(stream)).filter("run_uid is not null").select("run_uid", "script", is_start().alias("start"))

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            script = state.get[0]
            state.remove()
            yield pd.DataFrame({"run_uid": [key[0]], "state": ["interrupted"], "script": [script]})
            return
        frames = pd.concat(list(batches))
        if (~frames["start"]).any():
            if state.exists:
                state.remove()
            yield pd.DataFrame({"run_uid": [key[0]], "state": ["completed"], "script": [frames["script"].iloc[-1]]})
        else:
            state.update((frames["script"].iloc[0],))
            state.setTimeoutDuration(seconds * 1000)

    return rows.groupBy("run_uid").applyInPandasWithState(pair, "run_uid string, state string, script string", "script string", "append", GroupStateTimeout.ProcessingTimeTimeout)
