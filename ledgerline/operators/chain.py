"""Hash chains of a history: is each line where it was written?

Each line may claim the digest of the line before it. A line's verdict follows from the
claim, its predecessor, whether they agree, what its writer is able to do, and whether
the chain has started; the rules are tried in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.digest import version_numbers
from ledgerline.functions.tristate import CANNOT_CHECK

HOLDS_TRIVIAL, HOLDS, BROKEN, UNCHECKABLE, UNCHAINED, GAP, UNCLAIMED = "HOLDS_TRIVIAL", "HOLDS", "BROKEN", "UNCHECKABLE", "UNCHAINED", "GAP", "UNCLAIMED"
GENESIS, DIGEST, NONE = "GENESIS", "DIGEST", "NONE"
NONE_FIRST, READABLE, UNREADABLE = "NONE_FIRST", "READABLE", "UNREADABLE"
MATCHES, DIFFERS, NOT_APPLICABLE = "MATCHES", "DIFFERS", "NOT_APPLICABLE"
PRE_CHAIN, CAPABLE, UNSTATED, UNREADABLE_WRITER = "PRE_CHAIN", "CAPABLE", "UNSTATED", "UNREADABLE"
#: Fixed value: the first version that writes claims.
CHAINS_FROM = (0, 6, 0)


def classify(claim: Column, predecessor: Column, agreement: Column, writer: Column, started: Column) -> Column:
    """The status of a line; total over the five inputs."""
    first = predecessor == NONE_FIRST
    return (
        F.when((claim == GENESIS) & ~first, BROKEN)
        .when(first & (claim == GENESIS), HOLDS_TRIVIAL)
        .when(first & (claim == DIGEST), BROKEN)
        .when(first, F.when(writer == UNREADABLE_WRITER, UNCHECKABLE).otherwise(UNCHAINED))
        .when((claim == NONE) & ~started, UNCHAINED)
        .when((claim == NONE) & (writer == PRE_CHAIN), GAP)
        .when((claim == NONE) & (writer == UNREADABLE_WRITER), UNCHECKABLE)
        .when(claim == NONE, UNCLAIMED)
        .when(predecessor == UNREADABLE, F.when(agreement == MATCHES, HOLDS).otherwise(UNCHECKABLE))
        .otherwise(F.when(agreement == MATCHES, HOLDS).otherwise(BROKEN))
    )


def writer_of(version: Column, readable: Column) -> Column:
    """What the version that wrote a line is able to do."""
    numbers = version_numbers(version)
    old = numbers < F.array(*(F.lit(n).cast("bigint") for n in CHAINS_FROM))
    return F.when(~readable, UNREADABLE_WRITER).when(version.isNull() | (F.size(numbers) == 0), UNSTATED).when(old, PRE_CHAIN).otherwise(CAPABLE)


def links(lines: DataFrame, chain: str = "chain", position: str = "position", block: Column | None = None) -> DataFrame:
    """Lines with predecessor digest and status.

    ``lines``: chain, position, digest, digest_without_cr (null where the line has no carriage
    return at its end), claim (null, GENESIS or a digest), readable, version. ``block`` cuts a
    chain into stretches that follow each other in the order of positions, such as the blocks
    of a file: each is walked by itself, and what it needs of those before it, their last
    line and whether the chain had started, is one row for each block.
    """
    claim = F.when(F.col("claim").isNull(), NONE).when(F.col("claim") == GENESIS, GENESIS).otherwise(DIGEST)
    out = lines.select("*", claim.alias("claim_kind"), (block if block is not None else F.lit(0)).alias("__block"))
    order = Window.partitionBy(chain, "__block").orderBy(position)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.struct("digest", "digest_without_cr", "readable")
    ends = out.groupBy(F.col(chain).alias("__chain"), F.col("__block").alias("__of")).agg(F.max_by(line, position).alias("__last"), F.max(F.col("claim_kind") != NONE).alias("__claims"))
    blocks = Window.partitionBy("__chain").orderBy("__of")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__chain", "__of", F.lag("__last").over(blocks).alias("__prior"), F.coalesce(F.max("__claims").over(earlier), F.lit(False)).alias("__begun"))
    out = out.withColumns({"__before": F.lag(line).over(order), "__started": F.max(F.col("claim_kind") != NONE).over(so_far)})
    out = out.join(ends, F.col(chain).eqNullSafe(F.col("__chain")) & (F.col("__block") == F.col("__of")))
    out = out.withColumn("__before", F.coalesce("__before", "__prior")).withColumn("started", F.col("__started") | F.col("__begun"))
    out = out.withColumns({"before": F.col("__before.digest"), "before_without_cr": F.col("__before.digest_without_cr"), "before_readable": F.col("__before.readable")})
    predecessor = F.when(F.col("__before").isNull(), NONE_FIRST).when(F.col("before_readable"), READABLE).otherwise(UNREADABLE)
    agreement = F.when(F.col("claim_kind") != DIGEST, NOT_APPLICABLE).when(F.col("claim") == F.col("before"), MATCHES).otherwise(DIFFERS)
    translated = (F.col("claim_kind") == DIGEST) & (F.col("claim") != F.col("before")) & (F.col("claim") == F.col("before_without_cr"))
    status = F.when(F.coalesce(translated, F.lit(False)), UNCHECKABLE).otherwise(classify(F.col("claim_kind"), predecessor, agreement, writer_of(F.col("version"), F.col("readable")), F.col("started")))
    done = out.withColumn("translated", F.coalesce(translated, F.lit(False))).withColumn("status", status)
    return done.drop("__block", "__chain", "__of", "__prior", "__begun", "__before", "__started", "before_without_cr", "before_readable")


def report(linked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per chain: lines, attested (claims that hold), counts of each status and the verdict.

    BROKEN if any line is; CANNOT_CHECK where nothing is chained or a line is uncheckable,
    a gap, unclaimed or merged; INTACT otherwise. Unreadable lines alone decide nothing.
    """
    is_ = lambda *names: F.count_if(F.col("status").isin(*names))
    merged = F.count_if("merged") if "merged" in linked.columns else F.lit(0).cast("bigint")
    counted = linked.groupBy(*(by or ["chain"])).agg(F.count("*").alias("lines"), is_(HOLDS).alias("attested"), is_(BROKEN).alias("broken"), is_(UNCHECKABLE, GAP, UNCLAIMED).alias("doubtful"), is_(HOLDS, HOLDS_TRIVIAL).alias("chained"), merged.alias("merged"))
    verdict = F.when(F.col("broken") > 0, BROKEN).when((F.col("chained") == 0) | (F.col("doubtful") > 0) | (F.col("merged") > 0), CANNOT_CHECK).otherwise("INTACT")
    return counted.withColumn("verdict", verdict)
