"""Histories: append-only files of one JSON record a line, and the documents beside them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ledgerline.schema import RECORD, SIDECAR

BLANK, BAD, OK = "blank", "bad", "ok"
#: A torn line's claim, and a boundary of two records inside one line.
_RAW_CLAIM = r'^\{"prev": "(GENESIS|[0-9a-f]{64})"'
#: A closing brace that neither ends the line nor goes on with the object it stands in.
_MORE, _NO_END = r"\}\s*[^\s,\]}]", r"[^}\s]\s*$"
#: What JSON itself does not know is no record at the first reading.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_BOUNDARY = r'(?s)\}.?\{"|.\{"prev": "(?:GENESIS|[0-9a-f]{64})"'


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, position, raw) of each line, split at newlines alone; raw keeps the line's bytes.

    position orders the lines of a file: where its block begins, then the order of reading.
    """
    rows = spark.read.option("lineSep", "\n").text(list(paths))
    position = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.col("_metadata.file_path").alias("file"), position.alias("position"), F.col("value").alias("raw"))


@F.pandas_udf(BooleanType())
def _is_object(text: pd.Series) -> pd.Series:
    """Whether a text is one JSON object and nothing else; null stays null."""

    def one(t: bytes | None) -> bool | None:
        try:
            return None if t is None else isinstance(json.loads(t.decode()), dict)
        except (ValueError, RecursionError):
            return False

    return text.map(one)


def parsed(raw: DataFrame) -> DataFrame:
    """Lines with record (null unless ok), what was read of them, and parse_state: blank, bad (not a JSON object) or ok.

    Bad lines are kept and counted, never dropped; blank ones are no records but are lines.
    A line that is plain (read by the strict rules, nothing after the object, valid UTF-8)
    is judged by that one reading. All others are read by the lenient rules, and those that
    the variant parser refuses (it knows neither repeated keys nor NaN) or in which something
    may follow the object (both parsers overlook that) are judged one by one in Python.

    The reading stands in a generator, as filters on what it gives are not copied below one,
    and its first step in a lambda: a line is read once, whatever is asked of it later.
    """
    read = lambda options: F.from_json("raw", f"{RECORD}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", **options})
    good = lambda c: c.isNotNull() & c["__bad"].isNull()
    lead = F.ltrim("raw", F.lit(" \t\r"))
    more = F.col("raw").rlike(_MORE) | (~F.col("raw").endswith("}") & F.col("raw").rlike(_NO_END))
    held = lambda c, plain: F.struct(c.alias("record"), F.lit(plain).alias("plain"))
    either = F.transform(F.array(read(_STRICT)), lambda c: F.when(good(c) & ~more & F.is_valid_utf8("raw"), held(c, True)).otherwise(held(read({}), False)))
    out = raw.select("*", F.explode(either).alias("__e")).select(*raw.columns, F.col("__e.record").alias("__read"), F.col("__e.plain").alias("__plain"))
    asked = ~F.col("__plain") & (lead != "") & (F.try_parse_json("raw").isNull() | more)
    out = out.withColumn("__object", _is_object(F.when(asked, F.col("raw").cast("binary"))))
    state = F.when(lead == "", BLANK).when(~F.col("__object"), BAD).when(~good(F.col("__read")) | ~lead.startswith("{"), BAD).otherwise(OK)
    out = out.withColumn("parse_state", state).drop("__plain", "__object")
    return out.withColumn("record", F.when(F.col("parse_state") == OK, F.col("__read").dropFields("__bad")))


def records(lines_parsed: DataFrame) -> DataFrame:
    """Columns of all readable records, with file and position."""
    return lines_parsed.filter(F.col("parse_state") == OK).select("file", "position", "__read.*").drop("__bad")


def is_start() -> Column:
    """Whether a record marks a beginning; a record without a schema does not."""
    return F.coalesce(F.col("schema").rlike(r"\.start\.v\d+$"), F.lit(False))


def starts(recs: DataFrame) -> DataFrame:
    return recs.filter(is_start())


def completed(recs: DataFrame) -> DataFrame:
    """Runs that ended, with ``address``: the recorded name, else one made of script, start and sidecar."""
    part = lambda c: F.coalesce(c, F.lit(""))
    made = F.concat(F.lit("derived:"), F.concat_ws("|", part("script"), part("started_utc"), part("provenance_path")))
    return recs.filter(~is_start()).withColumn("address", F.coalesce(F.nullif("run_uid", F.lit("")), made))


def unreadable(lines_parsed: DataFrame, limit: int = 200) -> DataFrame:
    """The first bad lines, in order; the report shows so many by definition."""
    return lines_parsed.filter(F.col("parse_state") == BAD).select("file", "position", "raw").orderBy("file", "position").limit(limit)


def io_entries(runs: DataFrame) -> DataFrame:
    """(address, role, pos, path, kind, size, sha256, content_sha256, digests, started_utc, produced_at), a row for each input and output."""

    ended = F.coalesce(F.nullif("finished_utc", F.lit("")), F.col("started_utc"), F.lit(""))
    sides = F.array(*(F.struct(F.lit(role).alias("role"), F.col(f"{role}s").alias("entries")) for role in ("input", "output")))
    each = runs.select("address", F.coalesce("started_utc", F.lit("")).alias("started_utc"), ended.alias("produced_at"), F.explode(sides).alias("s"))
    each = each.select("address", "started_utc", "produced_at", "s.role", F.posexplode("s.entries").alias("pos", "e"))
    keep = F.array_distinct(F.filter(F.array("e.content_sha256", "e.sha256", "e.sha256_tree"), lambda d: d.isNotNull() & d.rlike("^[0-9a-f]{64}$")))
    return each.select("address", "role", "pos", "e.path", "e.kind", F.col("e.size_bytes").alias("size"), "e.sha256", "e.content_sha256", keep.alias("digests"), "started_utc", "produced_at")


def lineage_sides(io: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Producers and consumers of a history in the form that lineage.resolve takes."""
    packed = F.transform("digests", F.unhex)  # 64 hexadecimal digits each, so half the bytes to be sorted
    made = io.filter("role = 'output'").select(F.col("address").alias("src"), F.explode(packed).alias("digest"), F.col("produced_at").alias("at"))
    read = io.filter("role = 'input'").select(F.struct("address", "pos").alias("input"), F.col("address").alias("dst"), F.explode_outer(packed).alias("digest"), F.col("started_utc").alias("at"))
    return made, read


def claims(lines_parsed: DataFrame) -> DataFrame:
    """What each line says of itself: digests of its bytes, its claim, the version it states."""
    raw = F.col("raw")
    torn = F.nullif(F.regexp_extract(raw, _RAW_CLAIM, 1), F.lit(""))
    is_text = lambda c: F.coalesce(F.schema_of_variant(F.variant_get(F.try_parse_json("raw"), f"$.{c}", "variant")) == "STRING", F.lit(False))
    claim = F.when(F.col("parse_state") == OK, F.when(is_text("prev"), F.col("record.prev"))).otherwise(torn)
    stripped = F.when(raw.endswith("\r"), F.sha2(F.expr("substring(raw, 1, length(raw) - 1)").cast("binary"), 256))
    said = F.when(F.coalesce(F.schema_of_variant(F.variant_get(F.try_parse_json("raw"), "$.tool.version", "variant")) == "STRING", F.lit(False)), F.col("record.tool.version"))
    return lines_parsed.select(F.col("file").alias("chain"), "position", F.sha2(raw.cast("binary"), 256).alias("digest"), stripped.alias("digest_without_cr"), claim.alias("claim"), (F.col("parse_state") == OK).alias("readable"), said.alias("said"), F.col("record.run_uid").alias("uid"), ((F.col("parse_state") == BAD) & raw.rlike(_BOUNDARY)).alias("merged"))


def with_versions(own: DataFrame) -> DataFrame:
    """Lines with the version of their writer: a start line states none of its own, so the first one that its run states holds."""
    runs = own.filter("said is not null and uid is not null").groupBy(F.col("chain").alias("c"), F.col("uid").alias("u")).agg(F.min_by("said", "position").alias("run_said"))
    joined = own.join(runs, (F.col("chain") == F.col("c")) & (F.col("uid") == F.col("u")), "left")
    return joined.withColumn("version", F.coalesce("said", "run_said")).drop("c", "u", "uid", "said", "run_said")


def chain_lines(lines_parsed: DataFrame) -> DataFrame:
    """Lines in the form that chain.links takes: digests of their bytes, claims, writers' versions."""
    return with_versions(claims(lines_parsed)).select("chain", "position", "digest", "digest_without_cr", "claim", "readable", "version", "merged")


def sidecars(spark: SparkSession, *paths: str) -> DataFrame:
    """Full records, one JSON document a file, brought to the shape of history records where they nest."""
    raw = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"{RECORD}, {SIDECAR}").alias("r"))
    flat = raw.select("file", "r.*")
    merged = {"imported_code": F.coalesce("imported_code", "code.imported"), "packages": F.coalesce("packages", "environment.packages"), "environment_snapshot": F.coalesce("environment_snapshot", "environment.snapshot"), "git_commit": F.coalesce("git_commit", "code.git_commit")}
    return flat.withColumns(merged).drop("code", "environment")


def markers(spark: SparkSession, *paths: str) -> DataFrame:
    """Markers of running runs, one JSON document a file; unreadable ones are left out, newest first by name of start."""
    raw = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "run_uid string, script string, pid bigint, host string, started_utc string, history string").alias("m"))
    return raw.filter("m is not null").select("file", "m.*")


def tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path relative to root, size, modified[, sha256, text]) of all files below a folder.

    Without ``content`` the files' bytes are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.substring_index(F.col("path"), base + "/", -1)
    out = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    if not content:
        return out
    return out.select("path", "size", "modified", F.sha2("content", 256).alias("sha256"), "content")
