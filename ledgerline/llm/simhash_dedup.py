"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits is a ring of SEGMENTS segments. Two fingerprints within a
radius differ so little that from some segment on every chain of l consecutive
segments differs in at most floor(l * radius / SEGMENTS) bits. The first segments of
that chain, whose budget is 0, are the key of a candidate table; the budgets of the
longer chains prune candidates before the full Hamming distance is taken.

Only distinct fingerprints are compared. A key that many distinct fingerprints share is
split by the next segment of its chain, whose budget is one bit: fingerprints that agree
there but for one masked bit meet. What is still crowded lies so close together that
comparing pairs would cost the square of a group: such fingerprints are linked through
the points at distance one around them, of which two within radius 2 share at least one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import mapped, stored, table
from ledgerline.llm.components import components

BITS, SEGMENTS, RADIUS, SHINGLE, SEED = 64, 5, 2, 3, 42
#: Distinct fingerprints under one key up to which they are compared pair by pair.
CROWD = 32
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles, as an unsigned number; 0 where there are no words."""
    words = (text or "").encode().lower().split()  # both work on ASCII alone
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    gaps = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])[: len(words) - shingle + 1]
    ends = np.concatenate([gaps, [len(whole)]])[shingle - 1 :]
    parts = [whole[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED))), np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(votes * 2 > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of each row; a null text has the fingerprint of no words, 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return mapped(docs.select("doc_id", "text"), each, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _layout(segments: int, bits: int = BITS) -> list[int]:
    """Masks of the segments, from the low bits up."""
    edges = [round(bits * i / segments) for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def _chain_mask(masks: list[int], start: int, length: int) -> int:
    out = 0
    for k in range(length):
        out |= masks[(start + k) % len(masks)]
    return out


def ring_within(differ: list[Column], radius: int, segments: int, starts: dict[int, Column] | None = None) -> Column:
    """Whether fingerprints within ``radius`` can differ in these bits, and do.

    ``differ`` holds the words of 64 differing bits, low words first. Some chain of l
    segments from one start on must stay within floor(l * radius / segments) bits for
    each l, and all segments within the radius. ``starts`` says for which rows a start
    is asked (all by default).
    """
    masks = _layout(segments, 64 * len(differ))

    def count(mask: int) -> Column:
        parts = [(d, mask >> (64 * k) & (2**64 - 1)) for k, d in enumerate(differ)]
        out = F.lit(0)
        for d, m in parts:
            if m:
                out = out + F.bit_count(d.bitwiseAND(F.lit(_signed(m))))
        return out

    ring = F.lit(False)
    for i in range(segments):
        chain = starts[i] if starts else F.lit(True)
        for length in range(1, segments):
            chain &= count(_chain_mask(masks, i, length)) <= length * radius // segments
        ring |= chain
    return ring & (count((1 << (64 * len(differ))) - 1) <= radius)


def near_edges(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) over ``distinct`` (fp long, no repeats) that connect all fingerprints within ``radius``.

    Every edge is a pair within the radius or two members of one chain of such pairs; two
    fingerprints within the radius are always connected.
    """
    if not 1 <= radius <= 2 or segments <= radius:
        raise ValueError("the radius is 1 or 2, with more segments than that")
    budgets = [length * radius // segments for length in range(segments + 1)]
    exact = max(length for length in range(segments + 1) if budgets[length] == 0)
    masks = _layout(segments)
    fp = F.col("fp")

    def compared(keyed: DataFrame, key: list[str], label: str) -> tuple[DataFrame, DataFrame]:
        """(pairs under keys that are not crowded, rows under crowded keys)."""
        counts = stored(keyed.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), label)  # stored, so that the join can be split
        shared = stored(keyed.join(counts, key), label)
        few = shared.filter(F.col("n") <= crowd)
        same = F.col("x.fp") < F.col("y.fp")
        for c in key:
            same &= F.col(f"x.{c}") == F.col(f"y.{c}")
        ring = ring_within([F.col("x.fp").bitwiseXOR(F.col("y.fp"))], radius, segments, {i: F.col("x.i") == i for i in range(segments)})
        return few.alias("x").join(few.alias("y"), same & ring).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")), shared.filter(F.col("n") > crowd).drop("n")

    heads = F.array(*(F.struct(F.lit(i).alias("i"), fp.bitwiseAND(F.lit(_signed(_chain_mask(masks, i, exact)))).alias("key")) for i in range(segments)))
    pairs, crowded = compared(distinct.select("fp", F.explode(heads).alias("k")).select("fp", "k.i", "k.key"), ["i", "key"], "pigeonring")
    # the next segment of the chain may differ in its budget of one bit: rows meet where all but one masked bit agree
    tails = []
    for i in range(segments):
        head, tail = _chain_mask(masks, i, exact), masks[(i + exact) % segments]
        bits = [k for k in range(BITS) if tail >> k & 1]
        tails.append(F.when(F.col("i") == i, F.array(*(F.struct(F.lit(k).alias("masked"), fp.bitwiseAND(F.lit(_signed(head | tail & ~(1 << k)))).alias("key")) for k in bits))))
    closer, crowded = compared(crowded.select("fp", "i", F.explode(F.coalesce(*tails)).alias("k")).select("fp", "i", "k.masked", "k.key"), ["i", "masked", "key"], "pigeonring-next")
    around = F.array(fp, *(fp.bitwiseXOR(F.lit(_signed(1 << k))) for k in range(BITS)))
    balls = crowded.select("fp").distinct().select("fp", F.explode(around).alias("centre"))
    # a ball holds 65 points at most
    balls = balls.groupBy("centre").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    stars = balls.select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
    if radius == 1:  # only the centre itself is within distance one of the others
        stars = balls.filter(F.array_contains("members", F.col("centre"))).select(F.col("centre").alias("a"), F.explode("members").alias("b"))
    return pairs.unionAll(closer).unionAll(stars.filter("a <> b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of each row of documents.

    component_id is the least doc_id reachable over links of fingerprints that differ in
    at most ``radius`` bits, the row's own id included. Null and empty texts have
    fingerprint 0 and link like others; repeated rows stay; a null doc_id is linked but
    never names a group with another id; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = components(near_edges(distinct.select("fp"), radius))
    grouped = stored(distinct.join(found, distinct.fp == found.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")), "groups")
    named = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = grouped.select("fp", "component").join(named, "component").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents whose fingerprints link at 2 or fewer bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_dedup": op6_simhash_dedup}
