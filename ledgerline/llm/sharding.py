"""Sharding by sampled splitters, in DataFrame and SQL functions only.

Rows are ordered by (hash of the text, doc_id). A size-weighted sample of those keys
gives quantile splitters; ranges between splitters that turn out overfull are sampled
again and subdivided. Exact sizes of the ranges place every row in the global order.

Equal texts share a shard. Groups of them that are a visible part of a shard are dealt
out first, the largest to the emptiest shard; all other rows then fill what is left of
each shard in the order of their keys, so that the bytes of the shards are near equal,
whatever the sample was. Only a text whose rows exceed a shard's share is cut: into pieces.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import stored, table, text_or_empty

#: Bytes that a record costs besides its text.
OVERHEAD = 16
#: Rows that a range should hold, sampled keys for each range, ranges in all (larger tables have larger ranges).
RANGE_ROWS, SAMPLE_PER_RANGE, MAX_RANGES = 20_000, 32, 8_192
#: A range with more than so many times its share of rows is subdivided; rounds of that (what can't be cut then, rows
#: that are equal in text and id, stays one range: the order within it costs a sort of a task).
OVERFULL, ROUNDS = 4, 3
#: Equal texts above this part of a shard are dealt out before the other rows: shards / LARGE of them at most.
LARGE = 0.005
#: A text that exceeds a shard's share is cut into pieces of this part of it.
PIECE = 0.25


def _bounds(points: list[tuple[int, int | None]], parts: int) -> list[tuple[int, int | None]]:
    """Quantile boundaries of sorted keys: at the edge of a text's rows unless the sample shows the text to be hot."""
    picked = [points[i * len(points) // parts] for i in range(1, parts)] if points else []
    hot = {h for (h, _), (k, _) in zip(picked, picked[1:], strict=False) if h == k}
    return sorted({(h, d if h in hot else None) for h, d in picked}, key=lambda b: (b[0], -math.inf if b[1] is None else b[1]))


def _range_of(bounds: list[tuple[int, int | None]]) -> Column:
    """The number of boundaries at or below (h, doc_id), found over two levels of boundaries."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    kind = "array<struct<h:bigint,d:bigint>>"
    say = lambda bs: [{"h": h, "d": d} for h, d in bs]
    coarse_c = F.from_json(F.lit(json.dumps(say([f[0] for f in fine]))), kind)
    fine_c = F.from_json(F.lit(json.dumps([say(f) for f in fine])), f"array<{kind}>")
    below = lambda b: (b["h"] < F.col("h")) | ((b["h"] == F.col("h")) & (b["d"].isNull() | (b["d"] <= F.coalesce(F.col("doc_id"), F.lit(-(2**63))))))
    block = F.size(F.filter(coarse_c, below))
    within = F.size(F.filter(F.get(fine_c, block - 1), below))
    return F.when(block == 0, 0).otherwise((block - 1) * step + within).cast("int")


def _sampled(keys: DataFrame, points: int, total: int, salt: int) -> list[tuple[int, int | None]]:
    """About ``points`` keys, each drawn with a chance in proportion to its size; sorted."""
    unit = F.pmod(F.xxhash64("doc_id", "h", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    drawn = keys.filter(unit < F.col("size") * (points / max(1, total))).select("h", "doc_id")
    rows = [(r.h, r.doc_id) for r in drawn.collect()]
    return sorted(rows, key=lambda r: (r[0], -math.inf if r[1] is None else r[1]))


def _dealt(large: list[tuple[int, int, int]], shards: int, total: int) -> tuple[dict[tuple[int, int], int], list[float]]:
    """Shards of large (h, piece, bytes), the largest to the emptiest; what each shard has left for other rows."""
    loads = [(0, k) for k in range(shards)]
    place = {}
    for h, piece, size in sorted(large, key=lambda x: (-x[2], x[0], x[1])):
        load, k = heapq.heappop(loads)
        place[h, piece] = k
        heapq.heappush(loads, (load + size, k))
    held = [load for load, _ in sorted(loads, key=lambda x: x[1])]
    # the level to which the other rows fill all shards that are below it
    rest, level = total - sum(held), 0.0
    for n, load in enumerate(sorted(held), 1):
        level = (rest + sum(sorted(held)[:n])) / n
        if n < shards and level <= sorted(held)[n]:
            break
    return place, [max(0.0, level - load) for load in held]


def shard(keys: DataFrame, shards: int = 40, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    ``keys`` has doc_id, size (long, above 0) and h (long, equal for equal texts) and
    may have more columns. Equal texts share a shard unless their rows exceed a shard's share of bytes. Bytes of the shards
    are equal up to about LARGE of a shard and one record, where no text is larger than
    the others together leave room for. Repeated rows are rows like any other; an empty
    table gives no rows.
    """
    keys = stored(keys.withColumn("__row", F.monotonically_increasing_id()), "shard-keys")
    total = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    n, size = total["n"], total["b"]
    share = max(1.0, size / shards)
    # large groups: shards / LARGE rows at most, and pieces of those above a share: shards / PIECE at most
    groups = [(r.h, r.b) for r in keys.groupBy("h").agg(F.sum("size").alias("b")).filter(F.col("b") > LARGE * share).collect()]
    cut = {h: math.ceil(b / (PIECE * share)) for h, b in groups if b > share}
    spark = keys.sparkSession
    pieces = spark.createDataFrame([(h, cut.get(h, 1)) for h, _ in groups], "h long, pieces int")
    named = keys.join(F.broadcast(pieces), "h", "left").withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id", "__row"), F.coalesce("pieces", F.lit(1))).cast("int")))
    sizes = [(r.h, r.piece, r.b) for r in named.filter("pieces > 1").groupBy("h", "piece").agg(F.sum("size").alias("b")).collect()]
    place, room = _dealt([(h, 0, b) for h, b in groups if h not in cut] + sizes, shards, size)
    dealt = spark.createDataFrame([(h, p, k) for (h, p), k in place.items()], "h long, piece int, dealt int")
    named = named.join(F.broadcast(dealt), ["h", "piece"], "left").drop("pieces", "piece").withColumn("__small", F.when(F.col("dealt").isNull(), F.col("size")).otherwise(0))
    range_rows = max(range_rows, -(-n // MAX_RANGES))
    parts = max(1, n // range_rows)
    bounds = _bounds(_sampled(keys, parts * SAMPLE_PER_RANGE, size, 0), parts)
    for k in range(ROUNDS + 1):
        ranged = named.withColumn("part", _range_of(bounds))
        sized = ranged.groupBy("part").agg(F.sum("__small").alias("bytes"), F.count("*").alias("rows")).collect()  # at most about 2 MAX_RANGES rows
        over = {r["part"]: math.ceil(r["rows"] / range_rows) for r in sized if r["rows"] > OVERFULL * range_rows}
        if not over or k == ROUNDS:
            break
        for part, points in _points_of(keys, bounds, over, k + 1).items():
            inner = [points[i * len(points) // over[part]] for i in range(1, over[part])] if points else []
            bounds = sorted({*bounds, *inner}, key=lambda b: (b[0], -math.inf if b[1] is None else b[1]))
    at, offsets = 0, []
    for r in sorted(sized, key=lambda r: r["part"]):
        offsets.append((r["part"], at))
        at += r["bytes"]
    offset = spark.createDataFrame(offsets, "part int, bytes_before bigint")  # a row for each range
    order = Window.partitionBy("part").orderBy("h", "doc_id", "size", "__row")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("part", "h")
    placed = ranged.join(F.broadcast(offset), "part").withColumns({"__upto": F.sum("__small").over(upto) + F.col("bytes_before"), "__group": F.sum("__small").over(group)})
    # rows of a small group share its middle and so its shard
    middle = F.max("__upto").over(group) - F.col("__group") / 2
    edges = [sum(room[: k + 1]) for k in range(shards - 1)]
    below = F.array(*map(F.lit, edges)) if edges else F.expr("cast(array() as array<double>)")
    number = F.coalesce(F.col("dealt"), F.size(F.filter(below, lambda e: e <= F.col("__middle"))))
    ranked = placed.withColumn("__middle", middle).withColumn("shard", number.cast("int"))
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy("part", "shard").orderBy("h", "doc_id", "size", "__row")) - 1)
    ranked = stored(ranked.drop("bytes_before", "__upto", "__group", "__middle", "__small", "dealt", "__row"), "shards")
    # a range has rows of few shards: of those that it runs through and of its large groups
    counts = sorted((r["shard"], r["part"], r["n"]) for r in ranked.groupBy("shard", "part").agg(F.count("*").alias("n")).collect())
    starts, before = [], {}
    for k, part, rows in counts:
        starts.append((k, part, before.get(k, 0)))
        before[k] = before.get(k, 0) + rows
    start = spark.createDataFrame(starts, "shard int, part int, __start bigint")
    return ranked.join(F.broadcast(start), ["shard", "part"]).withColumn("slot", F.col("__rank") + F.col("__start")).drop("__rank", "__start", "part")


def _points_of(keys: DataFrame, bounds: list, over: dict[int, int], salt: int) -> dict[int, list]:
    """New samples of the overfull ranges alone, by range."""
    inside = keys.withColumn("part", _range_of(bounds)).filter(F.col("part").isin(list(over)))
    size = inside.agg(F.sum("size")).first()[0]
    unit = F.pmod(F.xxhash64("doc_id", "h", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    drawn = inside.filter(unit < F.col("size") * (sum(over.values()) * SAMPLE_PER_RANGE / max(1, size))).select("part", "h", "doc_id").collect()
    found: dict[int, list] = {}
    for r in sorted(drawn, key=lambda r: (r.h, -math.inf if r.doc_id is None else r.doc_id)):
        found.setdefault(r.part, []).append((r.h, r.doc_id))
    return found


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and h of documents; a null text counts as empty."""
    text = text_or_empty()
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    out = shard(keyed(table(spark, sf_dir, "documents", "doc_id", "text")), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_shards": op7_shards}
