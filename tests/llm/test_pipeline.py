import random
import re
from collections import defaultdict

import corpus_pipeline as cp
from ledgerline.llm import pii, simhash_dedup
from tests.llm.test_packing import held
from tests.llm.test_pii import brute
from tests.llm.test_simhash_dedup import brute_groups, brute_print
from tests.llm.test_suffix_dedup import words_of


def make(spark, path):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    shared = prose(70)
    docs, labels = [], []
    for k in range(300):
        ws = prose(rng.randrange(20, 120))
        toxic = k % 6 == 0
        if toxic:
            ws[2:4] = [rng.choice(["foul", "vile"]), rng.choice(["foul", "nasty"])]
        if k % 10 == 1:
            ws += shared
        if k % 10 == 2:
            ws.insert(5, f"me{k}@mail.example.com +1 (017) 555-{1000 + k}")
        docs.append((k, " ".join(ws), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    docs += [(300, docs[7][1], "en", "s", 0), (301, docs[7][1].upper(), "en", "s", 0), (302, None, "en", "s", 0), (303, "", "en", "s", 0), (11, docs[11][1], "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = make(spark, tmp_path)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(now.collect())
    toxic, near, cut, clean, packed = seen
    assert {r.doc_id for r in toxic} == {d for d, *_ in docs} - set(range(0, 300, 6))
    texts = {r.doc_id: r.text for r in toxic}
    groups = brute_groups(texts, lambda x, y: bin(brute_print(texts[x]) ^ brute_print(texts[y])).count("1") <= simhash_dedup.RADIUS)
    assert sorted(r.doc_id for r in near) == sorted(set(groups.values()))
    assert len(cut) == len(near)
    places = defaultdict(set)
    for r in cut:
        ws = words_of(r.text)
        for i in range(len(ws) - 49):
            places[tuple(ws[i : i + 50])].add(r.doc_id)
    assert max(map(len, places.values())) == 1
    before = {r.doc_id: r for r in cut}
    for r in clean:
        spans = brute(before[r.doc_id].text)
        assert (r.text != before[r.doc_id].text) == bool(spans) and not brute(r.text) and (r.text is None or r.n_chars == len(r.text))
        assert sum(r.text.count(f"[{k.upper()}]") for k in pii.KINDS) >= len(spans) if spans else True
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}
    assert not re.search(r"@", " ".join(r.text or "" for r in clean))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(cp.public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in clean}
    held([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in packed], want)
    assert cp.run(spark, str(tmp_path)).count() >= len(clean)
