import random
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import sharding


def held(rows, texts, shards):
    slots = defaultdict(list)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < shards for s in slots)


@pytest.mark.parametrize("hot", [0, 900])
def test_bytes_are_near_equal_whatever_is_hot(spark, hot):
    rng = random.Random(1)
    texts = ["x" * rng.randrange(200) + str(i) for i in range(2700)] + ["the same text"] * hot
    texts[5] = None
    texts[6] = ""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(sharding.stored(sharding.keyed(docs), "t"), 10, range_rows=100).collect()
    assert len(rows) == len(texts)
    held(rows, texts, 10)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 10
    assert max(sizes.values()) < mean + 0.01 * mean + 220 and min(sizes.values()) > mean - 0.01 * mean - 220


def test_equal_texts_share_a_shard_unless_they_exceed_it(spark):
    rng = random.Random(2)
    texts = [f"{i}" + "y" * rng.randrange(60) for i in range(1500)]
    for k in range(60):
        texts += ["z" * k] * rng.randrange(2, 40)
    texts += ["half a shard " * 3] * 100 + ["more than two shards " * 2] * 700
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sharding.shard(sharding.keyed(docs), 10, range_rows=50).collect()
    held(rows, dict(enumerate(texts)), 10)
    shards, sizes = defaultdict(set), Counter()
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
        sizes[r.shard] += r.size
    assert {t for t, s in shards.items() if len(s) > 1} == {"more than two shards " * 2}
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 10 + 200


def test_empty_and_tiny_tables_nulls_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(sharding.stored(sharding.keyed(empty), "t")).count() == 0
    few = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    rows = sharding.shard(sharding.stored(sharding.keyed(few), "t")).collect()
    assert len(rows) == 4
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
