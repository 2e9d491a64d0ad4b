import json
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(4)
SIGNS = "aAbz 's  n't\n\t\r09.,!?<|> \u0085\x1cÉéßΣıñ中文½²😀é_-'\x00"
TEXTS = ["", " ", "  ", "\n", "a \n b\n\nc  d   e", " 's 's x's \n's\t're", "<|endoftext|>", "a <|endoftext|> b", "x" * 5000, "don't  DON'T   we'll"]
TEXTS += ["".join(RNG.choice(SIGNS) for _ in range(RNG.randrange(1, 60))) for _ in range(1500)]


@pytest.fixture(scope="module")
def real():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_equal_the_library(real):
    e = packing.Encoder(PATH)
    for text, ids in zip(TEXTS, e.encode(TEXTS), strict=True):
        assert ids.tolist() == real(text), text
    assert e.ranked is not None


@pytest.mark.parametrize("text", ["a" * 1_000_000, " " * 1_000_000, " \n" * 500_000 + "x", "." * 1_000_000, "1" * 300_000, "中" * 300_000], ids=["letter", "space", "white", "sign", "digit", "wide"])
def test_very_long_runs(real, text):
    assert next(packing.Encoder(PATH).encode([text])).tolist() == real(text)


def test_other_files_go_through_the_library(tmp_path, real):
    spec = json.loads(Path(PATH).read_text())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "own.json").write_text(json.dumps(spec))
    e = packing.Encoder(str(tmp_path / "own.json"))
    assert e.ranked is None and next(e.encode(["word"])).tolist() == real(" word")


def test_waiting_pieces_do_not_hold_their_documents():
    p = packing.Packer(0)
    list(p.add(1, np.zeros(2048 * 50 + 5, np.uint32)))
    assert all(ids.base is None for held in p.open.values() for _, _, ids, _ in held)


def held(rows, want):
    """Checks pieces and offsets; returns the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r[0]].append(r)
        sequences[r[5]].append((r[6], r[2]))
    assert pieces.keys() == want.keys()
    for doc, ids in want.items():
        at = 0
        for _, start, length, crc, total, _, _ in sorted(pieces[doc], key=lambda r: r[1]):
            assert start == at and length > 0 and total == len(ids) and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        used, padded = used + at, padded + (0 if at & (at - 1) == 0 else 2048 - at)
    return padded / max(1, used)


def test_bins_hold_every_id_once_with_little_padding():
    rng = np.random.default_rng(1)
    packer = packing.Packer(7 << 40)
    want = {k: rng.integers(0, 50257, size).tolist() for k, size in enumerate([1, 2, 31, 63, 64, 65, 2047, 2048, 2049, 9000, *rng.integers(1, 3000, 400)])}
    rows = [r for k, ids in want.items() for r in packer.add(k, np.array(ids, np.uint32))]
    rows += packer.finish()
    assert held(rows, want) < 0.005
    assert list(packing.Packer(0).finish()) == []


def test_frames_with_nulls_and_empty_tables(spark, real):
    docs = [(i, t, 0) for i, t in enumerate(TEXTS[:60])] + [(90, None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, start int").repartition(3)
    rows = [tuple(r) for r in packing.pack(df, PATH).collect()]
    held(rows, {i: [*real(t or ""), 1] for i, t, _ in docs})
    assert packing.pack(df.limit(0), PATH).count() == 0
