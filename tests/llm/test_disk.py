import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerline.llm import common, near_texts
from ledgerline.llm import suffix_dedup as sd


def shuffled(spark):
    """Bytes of shuffle files that the session has written so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.fixture
def no_small_tables(spark):
    """As with large inputs, no table is small enough to be broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def corpus(spark, path):
    """Long texts, two of which hold one passage and two of which are near; and their bytes."""
    rng = random.Random(31)
    prose = lambda n: [f"{rng.getrandbits(64):x}" for _ in range(n)]
    passage, near = prose(60), prose(300)
    texts = [" ".join(prose(300)) for _ in range(400)]
    texts += [" ".join(prose(200) + passage), " ".join(passage + prose(200)), " ".join(near), " ".join(near[:-1]), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path), sum(len(t or "") for t in texts)


def test_split_loses_no_key(spark):
    keys = spark.range(0, 3000, 3).select((F.col("id") - 700).alias("k"))
    may, others = common.split(spark.range(-900, 5000).withColumn("a.b", F.lit(1)), F.col("id"), common.bitmap(keys))
    may, others = ([r.id for r in x.collect()] for x in (may, others))
    assert sorted(may + others) == list(range(-900, 5000)) and set(range(-700, 2300, 3)) <= set(may) and len(may) < 1100
    none = common.bitmap(keys.filter("k is null"))
    assert [x.count() for x in common.split(spark.range(5), F.col("id"), none)] == [0, 5]


def test_repeats_shuffle_only_texts_that_have_some(spark, tmp_path, no_small_tables):
    docs, size = corpus(spark, f"{tmp_path}/docs")
    before = shuffled(spark)
    rows = sd.without_repeats(docs).collect()
    assert shuffled(spark) - before < size
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [r.doc_id for r in rows if r.text != texts[r.doc_id]] == [401, 403] and len(rows) == len(texts)


def test_near_dedup_shuffles_only_texts_of_groups(spark, tmp_path, no_small_tables):
    docs, size = corpus(spark, f"{tmp_path}/docs")
    out = cp.drop_near_duplicates(spark, docs, "")
    before = shuffled(spark)
    rows = out.collect()
    assert shuffled(spark) - before < size / 10
    assert sorted(r.doc_id for r in rows) == [k for k in range(405) if k != 403]


def test_near_groups_holds_few_tables_at_once(spark, tmp_path, monkeypatch):
    docs, _ = corpus(spark, f"{tmp_path}/docs")
    folder, most, last = common.shared_dir(spark).removeprefix("file:") + "/ledgerline", [], common.stored
    old = set(os.listdir(folder)) if os.path.isdir(folder) else set()

    def stored(df, label):
        made = last(df, label)
        most.append({x.rpartition("-")[0] for x in os.listdir(folder) if x not in old})
        return made

    for module in (near_texts, common):
        monkeypatch.setattr(module, "stored", stored)
    near_texts.near_groups(docs).collect()
    assert max(map(len, most)) <= 11
    assert not any({"prints", "wanted"} <= live or {"leaders", "candidates"} <= live for live in most)
