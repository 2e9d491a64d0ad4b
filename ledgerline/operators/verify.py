"""Artifacts against their pins: does each still follow from its inputs?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, STALE, GONE, ALTERED, UNVERIFIABLE, NO_PIN = "OK", "STALE", "GONE", "ALTERED", "UNVERIFIABLE", "NO PIN"


def refused(name: Column, pinned: Column) -> Column:
    """Whether a pinned name can't be looked up: outside the project, escaped, or without a digest."""
    outside = name.startswith("<external>/") | name.startswith("/") | name.rlike(r"^[A-Za-z]:") | name.rlike(r"(^|/)\.\.(/|$)") | name.contains("\\")
    return outside | (pinned == "MISSING")


def check_inputs(entries: DataFrame, current: DataFrame) -> DataFrame:
    """Pinned inputs with status. ``entries``: artifact, pin_no, name, pinned. ``current``: name, digest, legacy (or null).

    ``current`` has each name once, so a file that many artifacts pin is digested once. A null
    digest is a file that is there and can't be read.
    """
    now = current.select("name", F.col("digest").alias("found"), F.lit(True).alias("there"))
    status = F.when(refused(F.col("name"), F.col("pinned")), UNVERIFIABLE).when(F.col("there").isNull(), GONE).when(F.col("found").isNull(), UNVERIFIABLE).when(F.col("found") == F.col("pinned"), OK).otherwise(STALE)
    return entries.join(now, "name", "left").withColumn("status", status).drop("there")


def artifact_status(pins: DataFrame, checked: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(artifact, status, pins, inputs, body_checked) of all artifacts.

    ``pins``: artifact, pin_no, declared, carried (entries found), body, body_now (null where it
    can't be told). ``artifacts``: artifact, all that were looked at. Worst first: ALTERED,
    STALE (a stale input, or a pin that carries fewer entries than it declares), GONE, OK
    (all inputs, or none where every pin says so), else UNVERIFIABLE.
    """
    has = lambda s: F.count_if(F.col("status") == s)
    inputs = checked.groupBy("artifact").agg(F.count("*").alias("inputs"), has(OK).alias("ok"), has(STALE).alias("stale"), has(GONE).alias("gone"))
    body = F.min_by(F.when(F.col("body").isNotNull() & F.col("body_now").isNotNull(), F.col("body") == F.col("body_now")), "pin_no")
    blocks = pins.groupBy("artifact").agg(F.count("*").alias("pins"), body.alias("body_holds"), F.count_if(F.col("declared").isNotNull() & (F.col("declared") != F.col("carried"))).alias("cut"), F.coalesce(F.bool_and(F.coalesce(F.col("declared") == 0, F.lit(False))), F.lit(False)).alias("none"))
    all_ = artifacts.select("artifact").join(blocks, "artifact", "left").join(inputs, "artifact", "left").fillna(0, ["inputs", "ok", "stale", "gone"])
    status = (
        F.when(F.col("pins").isNull(), NO_PIN).when(~F.col("body_holds"), ALTERED).when((F.col("stale") > 0) | (F.col("cut") > 0), STALE).when(F.col("gone") > 0, GONE)
        .when((F.col("inputs") > 0) & (F.col("ok") == F.col("inputs")), OK).when((F.col("inputs") == 0) & F.col("none"), OK).otherwise(UNVERIFIABLE)
    )
    return all_.select("artifact", status.alias("status"), F.coalesce("pins", F.lit(0)).alias("pins"), "inputs", F.col("body_holds").isNotNull().alias("body_checked"))


def verify_report(statuses: DataFrame, absent: int = 0) -> DataFrame:
    """One row: counters, why nothing could be checked (or null), and the exit code."""
    n = lambda s, c: F.count_if(F.col("status") == s).alias(c)
    out = statuses.agg(F.count("*").alias("seen"), F.count_if(F.col("status") != NO_PIN).alias("pinned"), n(OK, "ok"), n(STALE, "stale"), n(ALTERED, "altered"), n(GONE, "gone"), n(UNVERIFIABLE, "unverifiable"), F.count_if("body_checked").alias("body_checked"))
    wrong = (F.col("stale") + F.col("gone") + F.col("altered")) > 0
    why = F.when(wrong, F.lit(None)).when(F.lit(absent > 0), "a named path is absent").when(F.col("pinned") == 0, "nothing carries a pin").when(F.col("ok") == 0, "nothing could be compared")
    return out.withColumn("cannot_check", why).withColumn("exit_code", F.when(wrong, 1).when(F.col("cannot_check").isNotNull(), 2).otherwise(0))
