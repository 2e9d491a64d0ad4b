import random
import re
from collections import defaultdict

import pytest

from ledgerline.llm import suffix_dedup as sd


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute(docs):
    """Words (row, position) that lie in a window of MIN_WORDS words which stands elsewhere too."""
    at = defaultdict(list)
    for k, (_, text) in enumerate(docs):
        ws = words_of(text)
        for i in range(len(ws) - sd.MIN_WORDS + 1):
            at[tuple(ws[i : i + sd.MIN_WORDS])].append((k, i))
    return {(k, i + j) for places in at.values() if len(places) > 1 for k, i in places for j in range(sd.MIN_WORDS)}


def corpus():
    rng = random.Random(12)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}é" for _ in range(n)]
    shared = [fresh(n) for n in (49, 50, 51, 67, 68, 90, 140)]
    docs = []
    for k in range(60):
        body = fresh(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            cut = p[rng.randrange(3) :] if rng.random() < 0.4 else p
            at = rng.randrange(len(body) + 1)
            body = body[:at] + cut + body[at:]
        docs.append((k, rng.choice([" ", "\n", "  \t"]).join(body)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "same " * 130), (103, None), (104, ""), (105, " ".join(shared[6] + shared[6]))]
    docs += [(106, " ".join(fresh(400) + shared[5])), (None, docs[5][1]), (3, docs[3][1])]
    return docs


def test_repeated_words_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, h int").repartition(4)
    rows = sd.repeats(df).collect()
    by_row = defaultdict(set)
    owners = set()
    for r in rows:
        by_row[r.doc_id].add((r.start, r.end))
        assert r.end - r.start >= sd.MIN_WORDS
        if r.kept:
            owners.add((r.doc_id, r.start))
    want = defaultdict(set)
    for k, i in brute(docs):
        want[docs[k][0]].add(i)
    got = {d: {i for s, e in spans for i in range(s, e)} for d, spans in by_row.items()}
    assert got == want
    # what each row says of its owner is so
    text = dict(docs)
    held, order = defaultdict(int), lambda d, at: (d is not None, d or 0, at)
    for r in rows:
        n, words = r.end - r.start, words_of(text[r.doc_id])
        assert words[r.start : r.end] == words_of(text[r.owner_id])[r.owner_start : r.owner_start + n]
        assert ((r.doc_id, r.start) == (r.owner_id, r.owner_start)) if r.kept else order(r.owner_id, r.owner_start) <= order(r.doc_id, r.start)
        if r.kept:
            for i in range(r.start, r.end - sd.MIN_WORDS + 1):
                held[tuple(words[i : i + sd.MIN_WORDS])] += 1
    # each repeated window is kept in one place
    places = defaultdict(int)
    for _, t in docs:
        for i in range(len(words_of(t)) - sd.MIN_WORDS + 1):
            places[tuple(words_of(t)[i : i + sd.MIN_WORDS])] += 1
    assert held == {w: 1 for w, n in places.items() if n > 1}


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_neighbours_equal_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([5, 5, 5, rng.randrange(60)]), k // 3, k % 3) for k in range(200)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {(r.k, r.a, r.b): (r.before, r.after, (r.before_a, r.before_b) if r.before else None) for r in sd.neighbours(spark.createDataFrame(rows, "k long, a long, b int"), ["k"], ["a", "b"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows.sort()
    want = {}
    for x, y, z in zip([None, *rows], rows, [*rows[1:], None], strict=False):
        before, after = bool(x) and x[0] == y[0], bool(z) and z[0] == y[0]
        if before or after:
            want[y] = (before, after, x[1:] if before else None)
    assert got == want


def test_one_of_repeated_rows_keeps_its_words(spark):
    text = " ".join(f"w{k}" for k in range(80))
    df = spark.createDataFrame([(1, text, 0, 5, 7)] * 2 + [(None, None, 0, 5, 7)], "doc_id long, text string, n long, gone int, held int")
    rows = sd.without_repeats(df).collect()
    assert sorted(r.text for r in rows if r.doc_id) == ["", text] and len(rows) == 3 and rows[0].gone == 5
    assert sorted(r.kept for r in sd.repeats(df).collect()) == [False, True]


def test_every_repeated_window_stays_in_one_place(spark):
    docs = [(d, t) for d, t in corpus() if d is not None][:-1]
    df = spark.createDataFrame([(d, t, "en", -1) for d, t in docs], "doc_id long, text string, lang string, n_chars long")
    out = sd.without_repeats(df)
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(docs) and rows[103].text is None and rows[104].text == ""
    windows = lambda t: {tuple(ws[i : i + sd.MIN_WORDS]) for ws in [words_of(t)] for i in range(len(ws) - sd.MIN_WORDS + 1)}
    repeated = {(docs[k][0], i) for k, i in brute(docs)}
    before = {tuple(ws[i : i + sd.MIN_WORDS]) for d, t in docs for ws in [words_of(t)] for i in range(len(ws) - sd.MIN_WORDS + 1) if all((d, i + j) in repeated for j in (0, sd.MIN_WORDS - 1))}
    seen = defaultdict(int)
    for _, t in docs:
        for i in range(len(words_of(t)) - sd.MIN_WORDS + 1):
            seen[tuple(words_of(t)[i : i + sd.MIN_WORDS])] += 1
    before = {w for w in before if seen[w] > 1}
    after = set().union(*(windows(r.text) for r in rows.values()))
    assert before <= after
    touched = {docs[k][0] for k, _ in brute(docs)}
    assert all(rows[d].text == t for d, t in docs if d not in touched)
    assert rows[100].text == "" or len(rows[100].text) < len(docs[3][1])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.repeats(empty).count() == 0 and sd.without_repeats(empty).count() == 0
