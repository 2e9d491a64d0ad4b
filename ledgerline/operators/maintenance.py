"""Pruning of markers, resource requests, versions and package lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.digest import package_name

#: Fixed value: what separates the two halves of a package listing.
CONDA_SEPARATOR = "# --- conda-meta (conda / mamba / micromamba / pixi) ---"
#: A project name by the public packaging standard (PEP 508).
_PROJECT = r"(?i)^([A-Z0-9]|[A-Z0-9][A-Z0-9._-]*[A-Z0-9])$"


def prune_plan(own_host: Column, running: Column, age_seconds: Column, older_than: float) -> Column:
    """What becomes of a marker; the tests are tried in this order.

    ``running`` is null where it can't be told; so is ``age_seconds`` where no date is recorded.
    """
    return F.when(~own_host, "foreign").when(running, "running").when(running.isNull(), "untellable").when(age_seconds.isNull(), "undateable").when(age_seconds < older_than, "too_new").otherwise("remove")


def parse_seconds(text: Column) -> Column:
    """Seconds of an age such as 30d or 90m; null for a bare number or an unknown unit."""
    n, unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([smhdw])\s*$", 1), F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([smhdw])\s*$", 2)
    scale = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return F.when(n != "", n.try_cast("double") * scale)


def parse_bytes(text: Column) -> Column:
    """Bytes of a size such as 1GiB or 500MB; null for a bare number or an unknown unit."""
    n, unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([KMGT]i?B|B)\s*$", 1), F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([KMGT]i?B|B)\s*$", 2)
    power = F.when(unit == "B", 0).when(unit.startswith("K"), 1).when(unit.startswith("M"), 2).when(unit.startswith("G"), 3).otherwise(4)
    base = F.when(unit.contains("i"), 1024.0).otherwise(1000.0)
    return F.when(n != "", (n.try_cast("double") * F.pow(base, power)).cast("bigint"))


def resource_request(rss_bytes: Column, vms_bytes: Column, wall_seconds: Column, margin: float = 1.5) -> dict[str, Column]:
    """What to ask a scheduler for: MiB with a margin, whole minutes with a margin, h:m:s as it was; address space only where it is not below memory."""
    mib = lambda b: F.ceil(b / 1048576)
    s = wall_seconds.cast("bigint")
    return {
        "mem_mib": mib(rss_bytes * margin),
        "rss_mib": mib(rss_bytes),
        "vms_mib": F.when(vms_bytes >= rss_bytes, mib(vms_bytes)),
        "minutes": F.ceil(wall_seconds * margin / 60),
        "h_m_s": F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60),
    }


def parse_packages(lines: DataFrame, env: str, number: str, line: str) -> DataFrame:
    """(env, number, manager, name, version, build, kind) of each line of package listings.

    kind is pip, conda, separator, note (a comment or an empty line) or refused: the
    classification is total, so a listing with refused lines can be refused as a whole.
    """
    text = F.col(line)
    below = Window.partitionBy(env).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_conda = F.coalesce(F.max(text == CONDA_SEPARATOR).over(below), F.lit(False))
    # name==version above the separator, name=version[=build] below it
    at = F.instr(text, "==")
    project, pinned = F.left(text, at - 1), F.substr(text, at + 2)
    fields = F.split(text, "=", 3)
    name, version, build = (F.get(fields, k) for k in range(3))
    is_pip = (at > 1) & project.rlike(_PROJECT) & (pinned != "")
    is_conda = (F.size(fields) > 1) & (name != "") & ~name.rlike(r"[\s#]") & (version != "")
    kind = F.when(text == CONDA_SEPARATOR, "separator").when((F.trim(text) == "") | text.startswith("#"), "note").when(~in_conda & is_pip, "pip").when(in_conda & is_conda, "conda").otherwise("refused")
    out = lines.withColumn("kind", kind)
    pip, conda = F.col("kind") == "pip", F.col("kind") == "conda"
    return out.select(
        env, number, F.when(pip | conda, F.col("kind")).alias("manager"), F.when(pip, package_name(project)).when(conda, name).alias("name"),
        F.when(pip, pinned).when(conda, version).alias("version"), F.when(conda, build).alias("build"), "kind",
    )


def package_set_digest(packages: DataFrame, env: str, scheme: str) -> DataFrame:
    """(env, digest, n_packages, refused) of parsed listings; null where a line is refused or a name stands twice.

    ``scheme`` names the algorithm and is the first line of the digested text. A listing's
    packages are gathered, as the digest needs them in order.
    """
    line = F.when(F.col("manager") == "pip", F.concat_ws(" ", F.lit("pip"), "name", "version")).otherwise(F.concat(F.lit("conda "), F.col("name"), F.lit(" "), F.col("version"), F.lit(" "), F.coalesce("build", F.lit(""))))
    entry = F.struct(F.when(F.col("manager") == "pip", 0).otherwise(1).alias("half"), F.col("name").cast("binary").alias("key"), line.alias("line"))
    got = packages.groupBy(env).agg(F.array_sort(F.collect_list(F.when(F.col("manager").isNotNull(), entry))).alias("entries"), F.count_if(F.col("kind") == "refused").alias("refused"))
    # as texts, which are told apart by hashing; structs are compared each with each
    named = F.transform("entries", lambda e: F.concat(e["half"].cast("string"), F.coalesce(F.hex(e["key"]), F.lit("-"))))
    twice = F.size(F.array_distinct(named)) < F.size("entries")
    text = F.concat(F.lit(scheme), F.lit("\n"), F.array_join(F.transform("entries", lambda e: F.concat(e["line"], F.lit("\n"))), ""))
    return got.select(env, F.when((F.col("refused") == 0) & ~twice, F.sha2(text.cast("binary"), 256)).alias("digest"), F.size("entries").cast("bigint").alias("n_packages"), "refused", twice.alias("collides"))
