import hashlib
import random

import numpy as np

from ledgerline.llm import simhash


def brute_compare(docs):
    """Per row of (doc_id, text) in falling order: id, edited text, next text."""
    rows = sorted(docs, key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
    return [(d, simhash.edited(t or "", rows[(k + 1) % len(rows)][1] or ""), rows[(k + 1) % len(rows)][1] or "") for k, (d, t) in enumerate(rows)]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def test_rows_equal_brute_force_over_many_ranges(spark, tmp_path):
    rng = random.Random(6)
    docs = [(i * 7 % 501, prose(rng, rng.randrange(1, 80))) for i in range(501)] + [(None, "the last"), (9000, None), (9001, ""), (9002, "ñandú é")]
    spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, part string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in simhash.compare(spark.read.parquet(f"{tmp_path}/documents.parquet"), range_rows=40).collect()}
    assert len(rows) == len(docs)
    for d, changed, following in brute_compare(docs):
        text = dict(docs)[d] or ""
        prints = [bytes(x) for x in simhash.fingerprints([text, changed, following])]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), prints[0].hex(), prints[1].hex())
        assert r.near_edited == simhash.likeness(*(np.frombuffer(p, np.uint8)[None] for p in prints[:2]))[0]
        assert r.near_next == simhash.likeness(*(np.frombuffer(p, np.uint8)[None] for p in prints[::2]))[0]
    full = simhash.op2_simhash(spark, str(tmp_path)).collect()
    assert len(full) == len(docs) and all((r.n_within is not None) == (r.doc_id is not None and r.doc_id % 100 == 0) for r in full)


def test_edited_texts_are_nearer_than_strangers():
    rng = random.Random(9)
    texts = [prose(rng, n) for n in [3, 5, 9, 20, 50, 200, 900] * 20]
    changed = [simhash.edited(t, texts[k - 1]) for k, t in enumerate(texts)]
    a, b = simhash.fingerprints(texts), simhash.fingerprints(changed)
    assert np.mean(simhash.likeness(a, b) > simhash.likeness(a, np.roll(a, 1, axis=0))) > 0.97
    assert (simhash.likeness(a, a) == 1).all()


def test_repeated_ids_lone_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(5, "a b"), (5, "c d"), (4, "e f")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.compare(df).collect()) == [4, 5, 5]
    lone = simhash.compare(df.filter("doc_id = 4")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    assert simhash.compare(df.limit(0)).count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(128)
        for _ in range(8):
            prints.add(f"{base:032x}")
            base ^= sum(1 << b for b in rng.sample(range(128), rng.randrange(1, 3)))
    prints, asked = sorted(prints), sorted(prints)[::7]
    got = {(r.query, r.fingerprint, r.distance) for r in simhash.within(spark.createDataFrame([(p,) for p in prints], "fingerprint string"), spark.createDataFrame([(p,) for p in asked], "query string")).collect()}
    assert got == {(q, p, d) for q in asked for p in prints if (d := bin(int(q, 16) ^ int(p, 16)).count("1")) <= 3}
