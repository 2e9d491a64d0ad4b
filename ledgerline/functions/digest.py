"""Digests and their canonical texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the record format: header comments and JSON keys whose values change at every build.
VOLATILE_LINE = r"^#\s*(built_utc|generated_utc|run_utc|built_at)\b"
VOLATILE_KEYS = ("built_utc", "generated_utc", "run_utc", "built_at", "started_utc", "finished_utc", "drawn_utc", "mtime_utc", "acquired_utc")
#: Characters of a digest in a pin, and the fewest that identify one.
PIN_CHARS = 16


def lines_of(text: Column) -> Column:
    """Lines of a text with universal newlines; one newline at the end counts for nothing."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n\z", "")
    return F.split(plain, "\n", -1)


def stable_lines(text: Column) -> Column:
    """Lines without the volatile header comments."""
    return F.filter(lines_of(text), lambda line: ~line.rlike(VOLATILE_LINE))


def content_digest(text: Column) -> Column:
    """sha256 of a text that does not move when it is built again; null for a null text."""
    return F.sha2(F.array_join(stable_lines(text), "\n").cast("binary"), 256)


def record_digest(text: Column) -> Column:
    """As content_digest, for the engine's own JSON records: the values of volatile keys are blanked."""
    keys = "|".join(VOLATILE_KEYS)
    blanked = F.regexp_replace(F.array_join(stable_lines(text), "\n"), rf'"({keys})"\s*:\s*"[^"]*"', '"$1": ""')
    return F.sha2(blanked.cast("binary"), 256)


def pin_digest(content: Column, raw: Column, tree: Column) -> Column:
    """What a pin quotes of an input: the first digest that is there, cut, or MISSING."""
    full = F.coalesce(F.nullif(content, F.lit("")), F.nullif(raw, F.lit("")), F.nullif(tree, F.lit("")), F.lit("MISSING"))
    return F.substring(full, 1, PIN_CHARS)


def identifies(quoted: Column, full: Column) -> Column:
    """Whether a quoted beginning names a digest; too short a quote names nothing."""
    n = F.least(F.length(quoted), F.length(full))
    return (n >= PIN_CHARS) & (F.left(quoted, n) == F.left(full, n))


def tree_digest(files: DataFrame, keys: list[str], name: str, digest: str, casefold: bool = False, into: str = "sha256_tree") -> DataFrame:
    """Digest of a set of (name, digest) per group: ordered by the parts of the path, as bytes.

    The rows of one tree are gathered, as the digest needs them all in order; a tree is
    a directory's listing, not its contents.
    """
    shown = F.lower(F.col(name)) if casefold else F.col(name)
    parts = F.transform(F.split(shown, "/"), lambda p: p.cast("binary"))
    entry = F.struct(parts.alias("parts"), F.col(name).alias("name"), F.col(digest).alias("digest"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(e["name"], F.lit("\0"), e["digest"], F.lit("\0"))), "")
    return files.groupBy(*keys).agg(F.sha2(joined.cast("binary"), 256).alias(into), F.count("*").alias("n_files"))


def canonical_value(kind: str, value: Column) -> Column:
    """The type-tagged text of a scalar: unequal values never share one."""
    if kind == "string":
        body = F.concat(F.lit("s:"), F.length(value).cast("string"), F.lit(":"), value)
    elif kind == "int":
        body = F.concat(F.lit("i:"), value.cast("string"))
    elif kind == "bool":
        body = F.when(value, "b:1").otherwise("b:0")
    elif kind == "bytes":
        body = F.concat(F.lit("y:"), F.lower(F.hex(value)))
    else:
        raise ValueError(f"no canonical text for {kind}: it must be digested where the value lives")
    return F.when(value.isNull(), "n:").otherwise(body)


def canonical_row(**columns: tuple[str, Column]) -> Column:
    """The canonical text of a mapping from names to scalars, by name."""
    items = [F.concat(F.lit(f"s:{len(n)}:{n}="), canonical_value(*columns[n])) for n in sorted(columns)]
    return F.concat(F.lit(f"d:{len(items)}:{{"), F.concat_ws(",", *items), F.lit("}"))


def value_digest(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical.cast("binary"), 256), 1, PIN_CHARS)


def package_name(name: Column) -> Column:
    """A package's name in its normal form."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def version_numbers(version: Column) -> Column:
    """Up to three numbers of a version, for comparison as numbers."""
    return F.transform(F.slice(F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)), 1, 3), lambda n: n.try_cast("bigint"))
