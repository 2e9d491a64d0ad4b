import random

import pytest
import xxhash

from ledgerline.llm import simhash_dedup as sd
from ledgerline.llm.components import components


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(nodes, linked):
    left, out = sorted(nodes), {}
    while left:
        seed = left.pop(0)
        group, todo = {seed}, [seed]
        while todo:
            x = todo.pop()
            for y in [y for y in left if linked(x, y)]:
                left.remove(y)
                group.add(y)
                todo.append(y)
        out |= {x: min(group) for x in group}
    return out


def test_fingerprints_equal_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "One", "one two", "a b c", "Ärger ÄRGER x y z", "a\x1cb c d", "a b c d e", "x " * 5000]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    assert [sd.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("radius", "crowd"), [(1, 32), (2, 32), (2, 3), (1, 3)])
def test_edges_connect_what_brute_force_connects(spark, radius, crowd):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(9):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            fps.add(base)
    fps |= {signed_base for signed_base in range(1 << 6)}
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.component for r in components(sd.near_edges(df, radius, crowd=crowd)).collect()}
    want = brute_groups(map(signed, fps), lambda x, y: bin((x ^ y) & ((1 << 64) - 1)).count("1") <= radius)
    assert {x: got.get(x, x) for x in want} == want


def test_components_of_paths_cycles_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 7), (5, 5), (20, 1), (1, 20), (2**40, -(2**40))] + [(50, 200 + k) for k in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[9] == got[7] == 3 and 5 not in got and got[20] == 1 and got[2**40] == -(2**40) and got[239] == 50
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_with_nulls_repeats_and_extra_columns(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    docs = [(10, None, 1), (11, "", 1), (12, "  ", 2), (13, "lone", 3), (13, "lone", 3), (None, "lone", 4)]
    for k in range(12):
        body = [rng.choice(words) for _ in range(300)]
        docs.append((100 + 3 * k, " ".join(body), 0))
        docs.append((101 + 3 * k, " ".join(body).upper() if k % 2 else " ".join([*body[:-1], "changed"]), 0))
    spark.createDataFrame(docs, "doc_id long, text string, fp long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sd.op6_simhash_dedup(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    prints = {d: brute_print(t) for d, t, _ in docs}
    known = [d for d in prints if d is not None]
    want = brute_groups(known, lambda x, y: bin(prints[x] ^ prints[y]).count("1") <= 2)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else 13)
