"""Harmonic packing of token streams into sequences of a fixed capacity.

A document's ids are cut into pieces whose lengths are the reciprocals of the capacity
C: C, C/2, C/4 ... down to C/TAIL; what is left, shorter than that, is one piece of the
class j with C/(j+1) < length <= C/j. A bin of the class C/j takes exactly j pieces, so
the bins of the exact classes are full. Each worker fills its own bins; the pieces that
do not fill a last bin form one stream that is cut at powers of two, which are
sequences without padding. No worker needs another, and there is no shuffle.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.bpe import byte_signs
from ledgerline.llm.common import mapped, table

CAPACITY, END_ID = 2048, 1
#: The least exact class is capacity / TAIL; shorter rests are not cut.
TAIL = 32
#: Fixed value: the words of the byte-level scheme, written so that runs are never tried again.
WORDS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: White space from which on the word pattern would try back too often; such texts go through the library.
BLANKS = 1 << 16
_BLANK = re.compile(rf"\s{{{BLANKS}}}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level file.

    Where the ids of merged parts rise with the merges' order, as in the public files, a
    merge's id is its rank; the merge loop of tiktoken then gives the same ids at a fourth
    of the time. Texts that hold a special token or very much white space at
    once, and other files, go through the library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(path)

    def _ranked(self, path: str) -> tiktoken.Encoding | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        merged = [ids["".join(p.split(" ") if isinstance(p, str) else p)] for p in spec["model"]["merges"]]
        before = spec["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec["normalizer"]
        extra = [spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        if not plain or any(extra) or any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return None
        byte = {sign: b for b, sign in enumerate(byte_signs())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in ids.items() if t not in self.special}
        return tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        for text in texts:
            if self.ranked is None or any(s in text for s in self.special) or (len(text) >= BLANKS and _BLANK.search(text)):
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield np.array(self.ranked.encode_ordinary(text), np.uint32)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """A worker's encoder of a file; worker processes are reused, so it is made once."""
    return Encoder(path)


def cut(length: int, capacity: int = CAPACITY, tail: int = TAIL) -> Iterator[tuple[int, int]]:
    """(class j, piece length) of a document's pieces, in order; j pieces fill a bin."""
    at = 0
    for j in (1 << k for k in range(tail.bit_length())):
        while length - at >= capacity // j:
            yield j, capacity // j
            at += capacity // j
    if length > at:
        yield capacity // (length - at), length - at


class Packer:
    """The bins of one worker. Sequence ids are ``first``, ``first`` + 1 and so on."""

    def __init__(self, first: int, capacity: int = CAPACITY, tail: int = TAIL) -> None:
        self.next, self.capacity, self.tail = first, capacity, tail
        self.open: dict[int, list[tuple]] = {}

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Rows of the bins that the pieces of a document fill."""
        at = 0
        for j, size in cut(len(ids), self.capacity, self.tail):
            held = self.open.setdefault(j, [])
            # a piece that waits is copied, so that it does not keep its whole document in memory
            piece = ids[at : at + size]
            held.append((doc_id, at, piece if j == 1 else piece.copy(), len(ids)))
            at += size
            if len(held) == j:
                yield from self._close(self.open.pop(j))

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, self.next, offset
            offset += len(ids)
        self.next += 1

    def finish(self) -> Iterator[tuple]:
        """Rows of what is left: full bins, then sequences whose lengths are falling powers of two."""
        left = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        rest = sum(len(p[2]) for p in left)
        while rest:
            room = min(self.capacity, 1 << (rest.bit_length() - 1))
            rest -= room
            taken = []
            while room:
                doc_id, start, ids, total = left[0]
                taken.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    left[0] = (doc_id, start + room, ids[room:], total)
                else:
                    left.pop(0)
                room -= len(taken[-1][2])
            yield from self._close(taken)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, tail: int = TAIL) -> DataFrame:
    """Pieces of all documents (doc_id, text): see SCHEMA.

    A null text counts as empty: one piece of the end id. Repeated rows are packed as
    often as they stand; an empty table gives no rows; other columns are not read. A
    worker's bins follow from its partition alone, so a task that is run again after a
    loss gives the same rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, tail)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(texts), strict=True):
                rows += packer.add(doc_id, np.append(ids, np.uint32(END_ID)))
            if rows:
                yield batch_of(rows)
        if rows := list(packer.finish()):
            yield batch_of(rows)

    return mapped(docs.select("doc_id", "text"), each, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids of the public byte-level vocabulary."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op8_packing": op8_packing}
