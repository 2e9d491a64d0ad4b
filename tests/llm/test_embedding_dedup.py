import numpy as np
import pytest

from ledgerline.llm import embedding_dedup as ed


def brute(rows, cosine=0.98):
    good = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float32).astype(float)
    links = {k: set() for k in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] / (np.linalg.norm(good[i]) * np.linalg.norm(good[j])) >= cosine:
                links[i].add(j)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((rows[k][0], len(links[k]), min(rows[i][0] for i in seen)))
    return sorted(out)


@pytest.mark.parametrize("crowd", [2048, 7])
def test_rows_equal_brute_force(spark, crowd):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):
        v = rng.normal(size=16)
        for _ in range(rng.integers(1, 14)):
            rows.append((len(rows), v.astype(np.float32).tolist(), c % 2))
            v = v + rng.normal(size=16) * rng.choice([0, 0.02, 0.06, 0.15]) * np.linalg.norm(v) / 4
    rows += [(900 + k, rows[5][1], rows[5][2]) for k in range(30)]
    rows += [(950, None, 1), (951, [0.0] * 16, 1), (952, [1.0, None] + [0.0] * 14, 1), (953, [float("nan")] * 16, 0), (954, rows[0][1], None), (955, [], 1), (956, [1.0, 2.0], 0), (957, [2.0, 4.0], 0), (958, [float("inf")] + [0.0] * 15, 1), (959, [1e30] * 16, 1), (960, [1e-30] * 16, 1)]
    df = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, cid int").repartition(3)
    got = ed.near_duplicates(df, crowd=crowd, sample=100).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_probes_and_lookups_lose_no_pair():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 12))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.05])
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = ed.Index.fit(x[:300], 20, 0.98)
    own, codes, error, probes = index.encode(x)
    found = set()
    for c in range(len(index.centres)):
        held, asking = np.flatnonzero(own == c), np.array([k for k in range(len(x)) if c in probes[k]])
        if len(held) and len(asking):
            i, j = index.candidates(x[asking], c, codes[held], error[held])
            found |= set(zip(asking[i].tolist(), held[j].tolist(), strict=True))
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.98), strict=True)}
    assert want <= found and len(found) < 0.2 * len(x) ** 2


def test_empty_and_unsound_tables(spark):
    df = spark.createDataFrame([(1, None, 0), (2, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert ed.near_duplicates(df.limit(0)).count() == 0
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
