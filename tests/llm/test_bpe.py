import hashlib
import random
import time

import public_tokenizers
import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = "aAbzZs'tmdrevl 0129.,!?<|>\n\t\r \u0085\x1c​ÉéßΣσςİıñ中文字½²٣😀é̀ﬁ_-\x00"
TEXTS = [
    "", " ", "Hello, World! don't WE'LL they've 's ''s 'sam 're 'l 'll1", "a" * 3000, "12345 6x7", "ΑΣ ΑΣΑ Σ", "<|endoftext|>x<|startoftext|> <|endoftext|", "é é ́x",
    "日本語テキスト 123 ½", "x'y 's's's don''t '", "'", "' s", " 'd", "mixed\r\nlines\x0b\x0cend ",
]
RNG = random.Random(3)
TEXTS += ["".join(RNG.choice(SIGNS) for _ in range(RNG.randrange(1, 60))) for _ in range(1500)]


@pytest.fixture(scope="module")
def real():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_decoding_equal_the_library(real):
    got = list(bpe.WordCodec(PATH).digests(TEXTS))
    for text, (n, ids, decoded) in zip(TEXTS, got, strict=True):
        want = real.encode(text, add_special_tokens=False).ids
        assert n == len(want), text
        assert ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), text
        assert decoded == hashlib.sha256(real.decode(want, skip_special_tokens=False).encode()).hexdigest(), text


def test_a_full_table_is_emptied_and_results_stay(real):
    c = bpe.WordCodec(PATH)
    c.table.bound = 10
    for text in TEXTS[:300]:
        assert c.ids(text) == real.encode(text, add_special_tokens=False).ids


def test_words_of_one_name_are_told_apart(real, monkeypatch):
    names = bpe.word_hashes
    monkeypatch.setattr(bpe, "word_hashes", lambda *x: names(*x) % np.uint64(7))
    c = bpe.WordCodec(PATH)
    for _ in range(2):
        for text in TEXTS[:200]:
            assert c.ids(text) == real.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("signs", ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "éß中a"])
def test_long_words_merge_in_the_same_order(signs):
    v = bpe.Vocabulary(PATH)
    for n in (257, 400, 2000):
        word = "".join(RNG.choice(signs) for _ in range(n))
        raw = word.encode()
        parts = [v.inner[b] for b in raw[:-1]] + [v.last[raw[-1]]]
        monkey, bpe.SCANNED = bpe.SCANNED, 1 << 30
        try:
            want = v.encode(word)
        finally:
            bpe.SCANNED = monkey
        assert v._linked(parts) == want


def test_a_word_of_a_megabyte_takes_seconds():
    word = "".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    at = time.process_time()
    n, *_ = next(bpe.WordCodec(PATH).digests([word]))
    assert n > 100_000 and time.process_time() - at < 60


def test_frames_with_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "Hi there", 6), (1, "Hi there", 6), (None, "", 7)], "doc_id long, text string, n_tokens long")
    rows = bpe.encode_digests(df, PATH).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2]
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0
