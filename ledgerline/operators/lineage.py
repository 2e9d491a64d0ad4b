"""Lineage: which run made what another run read; and what follows from a run."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLVABLE, UNSEQUENCED, ORPHAN = "resolvable", "unsequenced", "orphan"


def resolve(producers: DataFrame, consumers: DataFrame, stripes: int = 256, sample: int = 20_000) -> DataFrame:
    """Each input with the latest producer of any of its digests that finished before its run started.

    ``producers``: src, digest, at (text or any ordered time). ``consumers``: input (names an
    input once), dst, digest, at; an input has a row for each of its digests, or one with a
    null digest. Result: input, dst, src, class. Of producers that finish at the same time
    the greatest name wins; a run is never its own producer; ``at`` of a producer equal to
    that of the consumer counts as before.

    No producer is paired with a consumer: the rows of a digest are walked in order of time,
    and carried along are the latest producer and the latest one of another run, which stands
    in where the first is the consumer itself. Of a digest that very many runs share (an
    empty file, say) each stripe of time is walked by itself; what its earlier stripes hold is
    one row each. Which digests these are, at most ``stripes``, a sample of about ``sample`` rows tells.
    """
    made = producers.filter("src is not null and digest is not null")
    read = consumers.filter("digest is not null")
    rows = made.select("digest", "at").unionAll(read.select("digest", "at"))
    n = rows.count()
    picked = rows.sample(min(1.0, sample / max(1, n)), 7).collect() if n > stripes else []
    often = Counter(bytes(r.digest) if isinstance(r.digest, bytearray) else r.digest for r in picked)
    hot = [d for d, k in often.items() if k * stripes >= len(picked)]
    times = sorted(r.at for r in picked if r.at is not None)
    edges = sorted({times[i * len(times) // stripes] for i in range(1, stripes)}) if times and hot else []
    is_hot = F.col("digest").isin(hot) if edges else F.lit(False)
    stripe = F.when(is_hot, _stripe(F.col("at"), edges, 0)).otherwise(0)
    point = F.when(F.col("at").isNotNull(), F.struct("at", "src"))
    both = made.select("digest", "at", F.lit(0).alias("side"), "src", point.alias("made")).unionByName(read.select("digest", "at", F.lit(1).alias("side"), "input", "dst"), allowMissingColumns=True).withColumn("stripe", stripe)
    part = Window.partitionBy("digest", "stripe")
    order = part.orderBy("at", "side", "src")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # where the latest producer changes from one run to another, the one before is the latest of another run
    walked = both.withColumn("prior", F.last("made", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    walked = walked.withColumn("turn", F.when(F.col("prior.src") != F.col("made.src"), F.col("prior")))
    found = walked.withColumns({"here": F.max("made").over(so_far), "other": F.max("turn").over(so_far), "least": F.min("src").over(part), "most": F.max("src").over(part)}).filter("side = 1")
    best = ["here", "other"]
    if edges:
        held = walked.filter(is_hot).groupBy(F.col("digest").alias("d"), F.col("stripe").alias("s")).agg(F.max("made").alias("here_s"), F.max("turn").alias("other_s"), F.min("src").alias("least_s"), F.max("src").alias("most_s"))
        whole = Window.partitionBy("d")
        before = whole.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("here_before", F.last("here_s", ignorenulls=True).over(before))
        held = held.withColumn("turn_s", F.coalesce("other_s", F.when(F.col("here_before.src") != F.col("here_s.src"), F.col("here_before"))))
        held = held.select("d", "s", "here_before", F.last("turn_s", ignorenulls=True).over(before).alias("other_before"), F.min("least_s").over(whole).alias("least_d"), F.max("most_s").over(whole).alias("most_d"))
        found = found.join(F.broadcast(held), (F.col("digest") == F.col("d")) & (F.col("stripe") == F.col("s")), "left").withColumns({"least": F.coalesce("least_d", "least"), "most": F.coalesce("most_d", "most")})
        best += ["here_before", "other_before"]
    latest = F.coalesce(*(F.when(F.col(f"{c}.src") != F.col("dst"), F.col(c)) for c in best))
    any_ = F.coalesce((F.col("least") != F.col("dst")) | (F.col("most") != F.col("dst")), F.lit(False))
    each = found.select("input", "dst", latest.alias("latest"), any_.alias("any"))
    alone = consumers.filter("digest is null").select("input", "dst", F.lit(None).cast(each.schema["latest"].dataType).alias("latest"), F.lit(False).alias("any"))
    one = each.unionAll(alone).groupBy("input", "dst").agg(F.max("latest").alias("latest"), F.max("any").alias("any"))
    kind = F.when(F.col("latest").isNotNull(), RESOLVABLE).when(F.col("any"), UNSEQUENCED).otherwise(ORPHAN)
    return one.select("input", "dst", F.col("latest.src").alias("src"), kind.alias("class"))


def _stripe(at: Column, edges: list, first: int) -> Column:
    """``first`` and how many of the ascending ``edges`` are at most ``at`` (null: none), as halvings.

    A lambda over an array would say the same, but the optimizer fails on one below this union.
    """
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(at >= F.lit(edges[mid]), _stripe(at, edges[mid + 1 :], first + mid + 1)).otherwise(_stripe(at, edges[:mid], first))


def resolve_ordered(producers: DataFrame, consumers: DataFrame, stripes: int = 256, sample: int = 20_000) -> DataFrame:
    """As :func:`resolve`, for inputs of one digest each that none of its own run's outputs bears.

    The as-of step is a running maximum over time in each digest's rows, so that digests with
    many producers and many consumers don't multiply. Time is cut into stripes at quantiles
    of a sample, and what a digest's earlier stripes hold is one row each: a digest that very
    many runs share is walked by as many tasks as there are stripes. Inputs without a digest
    meet nothing and stand in no window.
    """
    made = producers.select("digest", "at", F.lit(0).alias("side"), F.struct("at", "src").alias("made"), F.lit(None).alias("input"), F.lit(None).alias("dst"))
    known = consumers.filter("digest is not null")
    read = known.select("digest", "at", F.lit(1).alias("side"), F.lit(None).cast(made.schema["made"].dataType).alias("made"), "input", "dst")
    times = made.select("at").unionAll(read.select("at"))
    n = times.count()
    picked = sorted(r.at for r in times.sample(min(1.0, sample / max(1, n)), 7).collect() if r.at is not None)  # about ``sample`` values
    edges = sorted({picked[i * len(picked) // stripes] for i in range(1, stripes)}) if picked and n > stripes else []
    stripe = _stripe(F.col("at"), edges, 0)
    both = made.unionByName(read).withColumn("stripe", stripe)
    seen = Window.partitionBy("digest", "stripe").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("d").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    held = both.groupBy(F.col("digest").alias("d"), F.col("stripe").alias("s")).agg(F.max("made").alias("most"), F.count("made").alias("made_here"))
    held = held.withColumns({"earlier": F.max("most").over(before), "n": F.sum("made_here").over(Window.partitionBy("d"))}).select("d", "s", "earlier", "n")
    walked = both.withColumn("latest", F.max("made").over(seen)).filter("side = 1")
    walked = walked.join(held, (F.col("digest") == F.col("d")) & (F.col("stripe") == F.col("s"))).withColumn("latest", F.coalesce("latest", "earlier"))
    kind = F.when(F.col("latest").isNotNull(), RESOLVABLE).when(F.col("n") > 0, UNSEQUENCED).otherwise(ORPHAN)
    found = walked.select("input", "dst", F.col("latest.src").alias("src"), kind.alias("class"))
    alone = consumers.filter("digest is null").select("input", "dst", F.lit(None).cast(found.schema["src"].dataType).alias("src"), F.lit(ORPHAN).alias("class"))
    return found.unionAll(alone)


def counts(resolved: DataFrame) -> DataFrame:
    """One row: inputs, resolvable, unsequenced, orphan (which includes the unsequenced), ambiguous (always 0)."""
    is_ = lambda k: F.count_if(F.col("class") == k)
    return resolved.agg(F.count("*").alias("inputs"), is_(RESOLVABLE).alias("resolvable"), is_(UNSEQUENCED).alias("unsequenced"), (is_(UNSEQUENCED) + is_(ORPHAN)).alias("orphan"), F.lit(0).cast("bigint").alias("ambiguous"))


def edges(resolved: DataFrame) -> DataFrame:
    """(src, dst) of each resolved input; an input that stands twice gives two edges."""
    return resolved.filter(F.col("src").isNotNull()).select("src", "dst")
