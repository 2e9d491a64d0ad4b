"""SimHash fingerprints of documents, and permuted block tables that search them.

Terms are pairs of neighbouring words, weighted by their lengths, and in short texts
also runs of GRAM signs, whose weight fades out as a text grows to SHORT signs. Each
term's hash votes with its weight for or against each of BITS bits.

A search of radius r cuts fingerprints into blocks and permutes them so that each
choice of (blocks - r) blocks leads in one table: two fingerprints within r agree on
the leading blocks of one table at least, so joining the tables misses none.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.bpe import CHUNK, LETTER, NUMBER, classes, code_points, word_hashes
from ledgerline.llm.common import mapped, stored, table

BITS, GRAM, SHORT = 128, 5, 400
#: Search: bits that may differ, blocks that a fingerprint is cut into.
RADIUS, BLOCKS = 3, 4
#: Rows in a range of ids whose documents are read one after the other; the most ranges.
RANGE_ROWS, MAX_RANGES = 2_000, 65_536
_BYTE_VOTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, weight) of all terms."""
    cp, ends = code_points([t.lower() for t in texts])
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    kind = classes()[cp]
    sign = (kind == LETTER) | (kind == NUMBER)
    first = np.zeros(len(cp) + 1, bool)
    first[0] = True
    first[ends] = True
    mark = first.copy()
    mark[1:-1] |= sign[1:] != sign[:-1]
    starts = np.flatnonzero(mark[:-1])
    stops = np.append(starts[1:], len(cp))
    word = sign[starts]
    starts, stops = starts[word], stops[word]
    of, names, size = np.searchsorted(ends, starts, "right"), word_hashes(cp, starts, stops), stops - starts
    pair = of[1:] == of[:-1]
    hashes = (names[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + names[1:])[pair]
    weights = np.minimum(1.0, (size[:-1] + size[1:])[pair] / 16)
    owners = of[:-1][pair]
    lengths = np.diff(np.concatenate([[0], ends]))
    voted = np.bincount(owners, minlength=len(texts)) > 0
    fade = np.where(voted, np.clip(1 - lengths / SHORT, 0, 1), 1.0)
    begin = np.concatenate([[0], ends])[:-1]
    grams = []
    for k in np.flatnonzero((fade > 0) & (lengths > 0)):
        n = max(1, lengths[k] - GRAM + 1)
        at = begin[k] + np.arange(n)
        grams.append((np.full(n, k), at, np.minimum(at + GRAM, ends[k]), np.full(n, fade[k])))
    if grams:
        g_of, g_at, g_end, g_weight = (np.concatenate(x) for x in zip(*grams, strict=True))
        owners, hashes, weights = np.concatenate([owners, g_of]), np.concatenate([hashes, word_hashes(cp, g_at, g_end)]), np.concatenate([weights, g_weight])
    return owners, hashes, weights


def fingerprints(texts: list[str]) -> np.ndarray:
    """BITS/8 bytes for each text; equal texts have equal rows, a text without signs has zeros."""
    owners, hashes, weights = _terms(texts)
    order = np.argsort(owners, kind="stable")
    owners, hashes, weights = owners[order], hashes[order], weights[order]
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    slot, size = owners * 256, len(texts) * 256
    for lane in range(BITS // 64):
        parts = _mix(hashes, lane + 1).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            votes = np.bincount(slot + parts[:, k], weights, size).reshape(-1, 256) @ _BYTE_VOTES
            out[:, lane * 8 + k] = np.packbits(votes > 1e-9, axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the number of differing bits stands for, at least 0; 1 for equal fingerprints."""
    differ = np.bitwise_count(a ^ b).sum(axis=1)
    return np.maximum(0.0, np.cos(np.pi * differ / BITS))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _range_of(bounds: list[int], key: Column) -> Column:
    """The number of ascending bounds at or below a key, found over two levels."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse_c = F.from_json(F.lit(json.dumps([f[0] for f in fine])), "array<bigint>")
    fine_c = F.from_json(F.lit(json.dumps(fine)), "array<array<bigint>>")
    block = F.size(F.filter(coarse_c, lambda b: b <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + F.size(F.filter(F.get(fine_c, block - 1), lambda b: b <= key))).cast("int")


def with_following(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (part, ahead, doc_id, text) whose order within a partition is that of falling doc_id.

    Ids are cut into ranges at quantiles; a range's rows are followed by a copy of the
    first row of the range below it (of the very first row, after the last range),
    marked ``ahead``. The text is shuffled once. Equal ids follow each other by the
    hash of their texts; a null id comes last.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    n = docs.count()
    parts = max(1, min(MAX_RANGES, n // range_rows))
    bounds: list[int] = []
    if parts > 1:
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 4 * parts)).first()[0] or ()))
    docs = docs.withColumn("part", _range_of(bounds, key))
    tops = sorted((r["part"], r["top"]) for r in docs.groupBy("part").agg(F.max(key).alias("top")).collect())
    first = [(part, tops[k - 1][1]) for k, (part, _) in enumerate(tops)]  # the range below; below the lowest, the highest
    ahead = docs.sparkSession.createDataFrame(first, "part int, top bigint")  # a row for each range
    firsts = docs.drop("part").join(F.broadcast(ahead), key == F.col("top")).select("doc_id", "text", "part", F.lit(True).alias("ahead"))
    both = docs.withColumn("ahead", F.lit(False)).select("doc_id", "text", "part", "ahead").unionAll(firsts)
    return both.repartition("part").sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness: see the contract of op2.

    A null text counts as empty, whose fingerprint is zero; a lone document is
    followed by itself; repeated rows stay; an empty table gives no rows.
    """

    def finish(texts: list[str], rows: list[tuple[int | None, int, int]]) -> pa.RecordBatch:
        changed = [edited(texts[i], texts[j]) for _, i, j in rows]
        prints, new = fingerprints(texts), fingerprints(changed)
        here, following = prints[[i for _, i, _ in rows]], prints[[j for _, _, j in rows]]
        hexed = lambda xs: pa.array([bytes(x).hex() for x in xs], pa.string())
        cols = [pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(texts[i]) for _, i, _ in rows], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string())]
        cols += [hexed(here), hexed(new), pa.array(likeness(here, new)), pa.array(likeness(here, following))]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SCHEMA.split(", ")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        rows: list[tuple[int | None, int, int]] = []
        held, size = None, 0  # held: range, id and place of the row whose follower comes next
        for batch in batches:
            for doc_id, text, part, ahead in zip(*(batch.column(c) for c in ("doc_id", "text", "part", "ahead")), strict=True):
                doc_id, text, part = doc_id.as_py(), text.as_py(), part.as_py()
                if held is None and ahead.as_py():
                    continue  # a row of equal id: only the first one follows
                texts.append(text)
                size += len(text)
                if held is not None and held[0] == part:
                    rows.append((held[1], held[2], len(texts) - 1))
                held = None if ahead.as_py() else (part, doc_id, len(texts) - 1)
                if size > CHUNK and rows:
                    yield finish(texts, rows)
                    texts, rows, size = [text], [], len(text)
                    held = held and (held[0], held[1], 0)
        if rows:
            yield finish(texts, rows)

    return mapped(with_following(docs, range_rows), each, _SCHEMA)


def _blocks(fingerprint: Column, blocks: int) -> list[Column]:
    size = BITS // 4 // blocks
    return [F.substring(fingerprint, k * size + 1, size) for k in range(blocks)]


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fingerprint, distance) of all pairs within ``radius`` bits, by permuted block tables.

    ``prints`` has fingerprint and ``queries`` has query, hex strings of BITS bits
    without repeats. Every fingerprint stands in each table once; a query is compared
    with those alone that share the leading blocks of a table.
    """
    if not radius < blocks or (BITS // 4) % blocks:
        raise ValueError("more blocks than bits that may differ, which divide the fingerprint's hex digits")
    lead = list(itertools.combinations(range(blocks), blocks - radius))

    def tables(df: DataFrame, c: str) -> DataFrame:
        cut = _blocks(F.col(c), blocks)
        return df.select(c, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.concat(*(cut[b] for b in bs)).alias("lead")) for i, bs in enumerate(lead)))).alias("t")).select(c, "t.i", "t.lead")

    halves = range(BITS // 64)
    part = lambda c, at: F.conv(F.substring(F.col(c), at + 1, 8), 16, 10).cast("bigint")
    as_long = lambda c, k: F.shiftleft(part(c, k * 16), 32).bitwiseOR(part(c, k * 16 + 8))
    distance = sum((F.bit_count(as_long("query", k).bitwiseXOR(as_long("fingerprint", k))) for k in halves), F.lit(0))
    found = tables(queries.select("query"), "query").join(tables(prints.select("fingerprint"), "fingerprint"), ["i", "lead"])
    return found.select("query", "fingerprint", distance.alias("distance")).filter(F.col("distance") <= radius).distinct()


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    n_within is the number of other documents within RADIUS bits of the fingerprint,
    for the documents whose id is divisible by 100, against all; null for others.
    """
    found = stored(compare(table(spark, sf_dir, "documents")), "fingerprints")
    counts = stored(found.groupBy("fingerprint").agg(F.count("*").alias("n")), "counts")
    asked = found.filter("doc_id % 100 = 0").select(F.col("fingerprint").alias("query")).distinct()
    near = within(counts, asked).join(counts, "fingerprint").groupBy("query").agg((F.sum("n") - 1).alias("n_within"))
    asked_n = found.filter("doc_id % 100 = 0").join(near, found.fingerprint == near["query"], "left").select(*found.columns, "n_within")
    others = found.filter("not coalesce(doc_id % 100 = 0, false)").select("*", F.lit(None).cast("bigint").alias("n_within"))
    return asked_n.unionAll(others)


QUERIES = {"op2_simhash": op2_simhash}
