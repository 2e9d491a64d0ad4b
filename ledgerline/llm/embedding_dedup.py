"""Near-duplicate vectors by product quantisation, without loss.

Vectors are brought to length one. Coarse centroids (fitted on a bounded sample) cut
them into inverted lists; what a centroid leaves is coded in subspaces. A vector
probes every list that can hold one within the radius: x lies in the list of c, so q
is at most the radius beyond the plane between c and q's own centroid. Within a list
the table-lookup distance of q and x is off by the coding error of x at most, which
is kept beside the code; what that leaves is compared by exact cosine. So every pair
is found, whatever sample the index was fitted on; the sample only decides the cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import mapped, stored, table
from ledgerline.llm.components import components

COSINE = 0.98
#: Sampled vectors that the index is fitted on at most (expected), values in a subspace, rows of a list that a task holds.
SAMPLE, SUBSPACE, CROWD = 16_384, 4, 2_048
#: Sampled vectors that a list is fitted on at least: lists grow with the root of the vectors' number as far as the sample allows.
FITTED = 4
#: Codewords of a subspace: few, as a table of them is made for each query and list.
WORDS = 64
_SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = np.concatenate([((part**2).sum(1)[:, None] - 2 * part @ centres.T + (centres**2).sum(1)).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, d], len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centres)
    return centres


@dataclass
class Index:
    """Coarse centroids, the codewords of each subspace, and the radius of a search."""

    centres: np.ndarray
    words: np.ndarray  # subspaces x codewords x SUBSPACE
    radius: float

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, cosine: float) -> Index:
        rng = np.random.default_rng(0)
        centres = _kmeans(x, lists, 8, rng)
        rest = cls._split(x - centres[cls._nearest(x, centres)[0]])
        found = [_kmeans(rest[:, m], WORDS, 6, rng) for m in range(rest.shape[1])]
        words = np.stack([c[np.arange(WORDS) % len(c)] for c in found])
        return cls(centres, words, math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK)

    @staticmethod
    def _split(x: np.ndarray) -> np.ndarray:
        """Rows cut into subspaces; the last one is filled up with zeros."""
        parts = -(-x.shape[1] // SUBSPACE)
        return np.pad(x, ((0, 0), (0, parts * SUBSPACE - x.shape[1]))).reshape(len(x), parts, SUBSPACE)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row, and all squared distances."""
        d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
        return d.argmin(1), d

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """List, codes, coding error and probed lists of each row."""
        own, d = self._nearest(x, self.centres)
        rest = self._split(x - self.centres[own])
        codes = np.stack([self._nearest(rest[:, m], self.words[m])[0] for m in range(rest.shape[1])], axis=1).astype(np.uint8)
        coded = self.words[np.arange(rest.shape[1]), codes]
        error = np.sqrt(((rest - coded) ** 2).sum((1, 2)))
        apart = np.sqrt(np.maximum(0, self._nearest(self.centres, self.centres)[1]))
        reach = d - d[np.arange(len(x)), own][:, None] <= 2 * self.radius * apart[own] + _SLACK
        return own, codes, error, [np.flatnonzero(r) for r in reach]

    def candidates(self, q: np.ndarray, centre: int, codes: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of one list that table-lookup distances can't rule out."""
        rest = self._split(q - self.centres[centre]).transpose(1, 0, 2)
        # the tables of all queries, one product for each subspace
        tables = (rest**2).sum(2)[:, :, None] - 2 * rest @ self.words.transpose(0, 2, 1) + (self.words**2).sum(2)[:, None]
        total = np.zeros((len(q), len(codes)))
        for m in range(codes.shape[1]):
            total += tables[m][:, codes[:, m]]
        return np.nonzero(total <= (self.radius + error + _SLACK) ** 2)


def _local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node that each of n nodes reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)


def _units(column: pa.Array, dim: int) -> np.ndarray:
    v = _vectors(column, dim)
    return v / np.sqrt((v**2).sum(1))[:, None]


def _valid() -> Column:
    v = F.col("embedding")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(F.col("label").isNotNull() & v.isNotNull() & sound & F.exists(v, lambda c: c != 0), F.lit(False))


def _packed(rows: DataFrame) -> DataFrame:
    """Rows with ``embedding`` as bytes of 4-byte numbers."""
    names = rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([np.asarray(x.values, np.float32).tobytes() for x in batch.column("embedding")], pa.binary())
            yield pa.RecordBatch.from_arrays([own if c == "embedding" else batch.column(c) for c in names], names=names)

    return mapped(rows, each, ", ".join(f"{c} {'binary' if c == 'embedding' else t}" for c, t in rows.dtypes))


def _links_of(classes: DataFrame, dim: int, cosine: float, crowd: int, sample: int) -> DataFrame:
    """(links, a, b): with links, a class and its linked rows in one part of a list; without, an edge of classes."""
    n = classes.count()
    lists = max(1, min(sample // FITTED, math.isqrt(n)))
    some = classes.filter(F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / n)))).select("v")
    fitted = pa.array([r.v for r in some.collect()] or [classes.first().v], pa.binary())  # bounded by ``sample``
    index = Index.fit(_units(fitted, dim), lists, cosine)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own, codes, error, probes = index.encode(_units(part.column("v"), dim))
                cols = [part.column("label"), part.column("cid"), part.column("n"), part.column("v"), pa.array(own.astype(np.int32)), pa.array([bytes(c) for c in codes], pa.binary()), pa.array(error), pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["label", "cid", "n", "v", "list", "code", "error", "probes"])

    rows = stored(mapped(classes, coded, "label int, cid long, n long, v binary, list int, code binary, error double, probes array<int>"), "codes")
    asks = rows.select("label", "cid", "v", F.explode("probes").alias("list"))
    # a list is cut into parts of about ``crowd`` rows, its askers as well; each part of one meets each of the other
    sizes = rows.groupBy("label", "list").agg(F.ceil(F.count("*") / crowd).cast("int").alias("parts"))
    asked = asks.groupBy("label", "list").agg(F.ceil(F.count("*") / crowd).cast("int").alias("askers"))
    plan = stored(sizes.join(asked, ["label", "list"]), "parts")
    within = lambda c, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    key = ["label", "list", "part", "asker"]
    base = rows.join(plan, ["label", "list"]).withColumn("part", within("parts", 2)).select("label", "list", "part", every("askers").alias("asker"), "cid", "n", "v", "code", "error")
    query = asks.join(plan, ["label", "list"]).withColumn("asker", within("askers", 3)).select("label", "list", "asker", every("parts").alias("part"), "cid", "v")
    query = query.select(*(F.col(c).alias(f"q_{c}") for c in [*key, "cid", "v"]))  # other names: both sides stem from the same rows

    def compare(_: tuple, held: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        if held.num_rows and asking.num_rows:
            h = {c: held.column(c).combine_chunks() for c in ("cid", "n", "v", "code", "error")}
            codes = np.frombuffer(b"".join(h["code"].to_pylist()), np.uint8).reshape(held.num_rows, -1)
            ids, n, error = (np.asarray(h[c]) for c in ("cid", "n", "error"))
            asks_ids = np.asarray(asking.column("q_cid").combine_chunks())
            x, q = _vectors(h["v"], dim), _vectors(asking.column("q_v").combine_chunks(), dim)
            x_len, q_len = np.sqrt((x**2).sum(1)), np.sqrt((q**2).sum(1))
            centre = held.column("list")[0].as_py()
            linked = np.zeros(len(q), np.int64)
            pairs = []
            for at in range(0, len(q), 256):
                some = slice(at, at + 256)
                i, j = index.candidates(q[some] / q_len[some, None], centre, codes, error)
                i = i + at
                ok = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", q[i[k : k + 65536]], x[j[k : k + 65536]]) / (q_len[i[k : k + 65536]] * x_len[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536))])
                i, j = i[ok], j[ok]
                other = asks_ids[i] != ids[j]
                i, j = i[other], j[other]
                linked += np.bincount(i, n[j], len(q)).astype(np.int64)
                nodes, local = np.unique(np.concatenate([asks_ids[i], ids[j]]), return_inverse=True)
                root = _local_roots(local[: len(i)], local[len(i) :], len(nodes))
                moved = root != np.arange(len(nodes))
                pairs.append((nodes[moved], nodes[root[moved]]))
            some = linked > 0
            a = np.concatenate([asks_ids[some], *(p[0] for p in pairs)])
            found = [np.concatenate([linked[some], np.zeros(len(a) - some.sum(), np.int64)]), a, np.concatenate([asks_ids[some], *(p[1] for p in pairs)])]
        return pa.table({"links": pa.array(found[0], pa.int64()), "a": pa.array(found[1], pa.int64()), "b": pa.array(found[2], pa.int64())})

    return stored(base.groupBy(*key).cogroup(query.groupBy(*(f"q_{c}" for c in key))).applyInArrow(compare, "links long, a long, b long"), "links")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, crowd: int = CROWD, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row with vec_id, embedding and label.

    Rows link when their labels are equal and their cosine is at least ``cosine``;
    n_links counts the other rows that a row links with, equal vectors included. Null,
    zero and unsound vectors and rows without a label link with nothing and name
    themselves; vectors of different lengths never link. Equal vectors are compared
    once; repeated rows count as rows; an empty table gives no rows.
    """
    rows = stored(vectors.select("vec_id", "label", "embedding", _valid().alias("sound")), "vectors")
    # equal vectors by their values: a hash alone could take two for one
    same = ["label", "embedding"]
    equal = stored(rows.filter("sound").groupBy(*same).agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id")), "equal")
    named = stored(equal.withColumn("cid", F.monotonically_increasing_id()), "named")
    classes = stored(_packed(named).withColumn("dim", (F.octet_length("embedding") / 4).cast("int")).withColumnRenamed("embedding", "v"), "classes")
    members = rows.filter("sound").select("vec_id", *same).join(named.select("cid", *same), same).select("vec_id", "cid")
    rows = stored(members.unionAll(rows.filter(~F.col("sound")).select("vec_id", F.lit(None).cast("bigint"))), "members")
    found = None
    for dim in sorted(r.dim for r in classes.select("dim").distinct().collect()):
        part = _links_of(classes.filter(F.col("dim") == dim).select("label", "cid", "n", "v"), dim, cosine, crowd, sample)
        found = part if found is None else found.unionAll(part)
    plain = rows.select("vec_id", "cid")
    if found is None:
        return plain.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = found.filter("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    reach = components(found.filter("links = 0"))
    named = stored(classes.join(reach, classes.cid == reach.node, "left").select("cid", "n", "first_id", F.coalesce("component", "cid").alias("component")), "groups")
    firsts = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    info = named.join(firsts, "component").join(linked, F.col("cid") == F.col("a"), "left").select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    out = plain.filter("cid is not null").join(info, "cid").select("vec_id", F.col("links").alias("n_links"), "component_id")
    out = out.unionAll(plain.filter("cid is null").select("vec_id", F.lit(0).cast("bigint"), F.col("vec_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at a cosine of 0.98 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


_SOUND = "label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
ORACLE = {
    "op5_embedding_dedup": f"""
with recursive rows as (select vec_id, label, embedding, list_transform(embedding, lambda x: x::double) as v from embeddings),
sound as (select vec_id, label, v from rows where {_SOUND}),
links as (
  select x.vec_id as a, y.vec_id as b from sound x join sound y on x.label = y.label and len(x.v) = len(y.v) and x.vec_id <> y.vec_id
  where list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.98),
reach(node, found) as (select vec_id, vec_id from rows union select reach.node, links.b from reach join links on reach.found = links.a)
select r.vec_id, (select count(*) from links where a = r.vec_id) as n_links, min(reach.found) as component_id, min(reach.found) = r.vec_id as kept
from rows r join reach on reach.node = r.vec_id group by r.vec_id
"""
}
QUERIES = {"op5_embedding_dedup": op5_embedding_dedup}
