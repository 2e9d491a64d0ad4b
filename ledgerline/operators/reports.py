"""Which run made an artifact; two environments; two runs in all dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.digest import identifies
from ledgerline.operators import compare


def find_match(outputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(artifact, run, how) of each artifact (path, sha256): the last run that wrote its path, else the one run that recorded its bytes.

    ``outputs``: run, path, sha256, order. how is path, digest or none; bytes that several runs
    recorded name none of them.
    """
    by_path = outputs.groupBy("path").agg(F.max_by("run", "order").alias("path_run"))
    by_bytes = outputs.filter("sha256 is not null").groupBy("sha256").agg(F.min("run").alias("one"), (F.min("run") == F.max("run")).alias("unique"))
    both = artifacts.join(by_path, "path", "left").join(by_bytes, "sha256", "left")
    run = F.coalesce("path_run", F.when(F.col("unique"), F.col("one")))
    how = F.when(F.col("path_run").isNotNull(), "path").when(F.col("unique"), "digest").otherwise("none")
    return both.select(F.col("path").alias("artifact"), run.alias("run"), how.alias("how"))


def environment_verdict(set_a: Column, set_b: Column, differences: Column) -> Column:
    """SAME, DIFFERS or CANNOT_CHECK of two package-set digests and the number of named differences (null where lists are not known)."""
    same = identifies(set_a, set_b)
    blocked = set_a.isNull() | set_b.isNull() | (same & (F.coalesce(differences, F.lit(0)) > 0)) | (~same & (differences == 0))
    return F.when(F.coalesce(blocked, F.lit(True)), "CANNOT_CHECK").when(same, "SAME").otherwise("DIFFERS")


def _files(runs: DataFrame, address: str, role: str) -> DataFrame:
    rows = runs.filter(F.col("address") == address).select(F.explode(f"{role}s").alias("e"))
    digest = F.coalesce("e.sha256", "e.content_sha256")
    return rows.select(F.col("e.path").alias("key"), digest.alias("value")).groupBy("key").agg(F.last("value").alias("value"))


def _pairs(runs: DataFrame, address: str, values: dict[str, Column]) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(n).alias("key"), v.cast("string").alias("value")) for n, v in values.items()))
    return runs.filter(F.col("address") == address).select(F.explode(kinds).alias("p")).select("p.key", "p.value")


def _map(runs: DataFrame, address: str, column: str) -> DataFrame:
    return runs.filter(F.col("address") == address).select(F.explode(column).alias("key", "value"))


def _variant_map(runs: DataFrame, address: str, column: str) -> DataFrame:
    return runs.filter(F.col("address") == address).select(F.explode(F.from_json(F.to_json(column), "map<string,string>")).alias("key", "value"))


def diff_runs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(dimension, examined, differences, blocked, verdict) of two runs, always in all dimensions.

    A dimension that finds no difference but could not see everything is NOT_COMPARABLE.
    """
    two = runs.filter(F.col("address").isin(a, b))
    facts = two.agg(
        F.bool_or(F.coalesce(F.size("unregistered_reads"), F.lit(0)) > 0).alias("unregistered"),
        F.bool_or(F.coalesce("observation.unregistered_watch_truncated", F.lit(0)) > 0).alias("truncated"),
        F.bool_or(~F.coalesce("git_status_captured", F.lit(False))).alias("no_status"),
        F.bool_or(F.coalesce("git_code_dirty", F.lit(False))).alias("dirty"),
        F.bool_or(F.col("status").isNull() | (F.col("status") == "running")).alias("open"),
        F.count_if(F.col("status") != "ok").alias("not_ok"),
        F.bool_or(F.col("resources").isNull()).alias("no_resources"),
        (F.count_distinct(F.coalesce("resources.source", F.lit(""))) > 1).alias("sources"),
        (F.count_distinct(F.coalesce("observation.packages_recorded", F.lit(""))) > 1).alias("recorded"),
        (F.count_distinct(F.coalesce("schema", F.lit(""))) > 1).alias("schemas"),
    ).first()
    said = lambda *pairs: next((F.lit(why) for hit, why in pairs if hit), None)
    io_block = ((facts["unregistered"], "reads were not registered"), (facts["truncated"], "the watch was cut short"), (facts["schemas"], "the records have different schemas"))

    def files(role: str) -> DataFrame:
        d = compare.map_diff(_files(runs, a, role), _files(runs, b, role), ["key"])
        lacking = F.max(F.when((F.col("change") == compare.SAME) & F.col("value_a").isNull(), "a side lacks a digest"))
        out = compare.dimension(d, f"{role}s", said(*(io_block if role == "input" else io_block[2:])))
        missing = d.agg(lacking.alias("why")).first()["why"]
        if missing:
            out = out.withColumn("blocked", F.coalesce("blocked", F.lit(missing))).withColumn("verdict", F.when(F.col("differences") > 0, compare.DIFFERENT).otherwise(compare.NOT_COMPARABLE))
        return out

    one = lambda name, values, *why: compare.dimension(compare.map_diff(_pairs(runs, a, values), _pairs(runs, b, values), ["key"]), name, said(*why))
    code = one("code", {"commit": F.col("git_commit"), "imported": F.col("imported_code.digest")}, (facts["no_status"], "git status was not captured"), (facts["dirty"], "the tree was dirty"))
    status = one("status", {"status": F.col("status")}, (facts["open"], "a run is not over")).withColumn("differences", F.greatest("differences", F.lit(facts["not_ok"]))).withColumn("verdict", F.when(F.col("differences") > 0, compare.DIFFERENT).otherwise(F.col("verdict")))
    parameters = compare.dimension(compare.map_diff(_variant_map(runs, a, "parameters"), _variant_map(runs, b, "parameters"), ["key"]), "parameters")
    packages = compare.dimension(compare.map_diff(_map(runs, a, "packages"), _map(runs, b, "packages"), ["key"]), "packages", said((facts["recorded"], "packages were recorded in different ways")))
    steps = one("steps", {"steps": F.to_json("steps")}, (facts["schemas"], "the records have different schemas"))
    floors = {"wall_seconds": 0.5, "cpu_seconds": 0.5, "max_rss_bytes": float(8 << 20)}
    figures = lambda x: _pairs(runs, x, {n: F.col(f"resources.{n}") for n in floors})
    d = compare.map_diff(figures(a), figures(b), ["key"])
    floor = F.create_map(*(F.lit(x) for kv in floors.items() for x in kv))[F.col("key")]
    gap, big = F.abs(F.col("value_a").cast("double") - F.col("value_b").cast("double")), F.greatest(F.abs(F.col("value_a").cast("double")), F.abs(F.col("value_b").cast("double")))
    d = d.withColumn("change", F.when((gap > big * 0.05) & (gap > floor), compare.CHANGED).otherwise(compare.SAME))
    resources = compare.dimension(d, "resources", said((facts["no_resources"], "a side has no figures"), (facts["sources"], "the figures have different sources")))
    out = files("input")
    for part in (files("output"), code, status, parameters, packages, steps, resources):
        out = out.unionByName(part)
    return out
