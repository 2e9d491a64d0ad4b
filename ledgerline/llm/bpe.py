"""Byte-level BPE by contiguous rank arrays, with vectorised word splitting and a word table.

A batch of texts becomes one array of code points; runs of a class are found with
array operations, words are named by a 64-bit rolling hash and compared with the word of
that name, and only words that a worker has not met are encoded. A word's parts and the
ranks of its adjacent pairs stand in two short lists: the least rank is found by scanning,
its boundary deleted and the two neighbouring ranks refreshed, until no pair can be merged.
Words that are not short keep the pairs in a heap and the parts in a linked list instead,
so that their time stays near linear; they merge in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import mapped, table

#: Code points that are handled together, words and code points of words that a worker remembers, longest word that is
#: named by its rolling hash, longest word (in bytes) whose ranks are scanned.
CHUNK, REMEMBERED, REMEMBERED_SIGNS, LONG, SCANNED = 1 << 18, 300_000, 1 << 23, 48, 256
OTHER, LETTER, NUMBER, WHITE = range(4)
#: Unicode white space.
_WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = WHITE
    return out


@lru_cache(1)
def _mixed() -> np.ndarray:
    """A pseudo-random 64-bit value for every code point."""
    x = np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (base, inverse))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One array of code points and the offset at which each text ends."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))


def word_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word; equal words have equal names at any place."""
    size = CHUNK
    while size < len(cp):
        size *= 2
    power, inverse = _powers(size)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mixed()[cp] * power[: len(cp)])])
    out = (total[ends] - total[starts]) * inverse[starts]
    out ^= (ends - starts).astype(np.uint64) * np.uint64(_BASE)
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = xxhash.xxh3_64_intdigest(cp[starts[i] : ends[i]].tobytes())
    return out


def _runs(cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, token starts (as marks), and starts, ends and followers of runs; a text's edge ends a run."""
    kind = classes()[cp]
    first = np.zeros(len(cp) + 1, bool)
    first[0] = True
    first[ends] = True
    mark = first.copy()
    mark[1:-1] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(mark[:-1])
    stops = np.append(starts[1:], len(cp))
    return kind, mark, starts, stops, ~first[stops]


def _join_contractions(cp, kind, mark, starts, stops, follows) -> None:
    """Move marks so that 's 't 'm 'd 're 've 'll are words of their own, where the quote starts a word alone."""
    at = np.flatnonzero((stops - starts == 1) & follows & (cp[starts] == 39) & mark[starts])
    at = at[kind[stops[at]] == LETTER]
    if not len(at):
        return
    head = stops[at]
    width = stops[at + 1] - head
    one = cp[head]
    two = cp[np.minimum(head + 1, len(cp) - 1)]
    long = (width > 1) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    short = np.isin(one, [ord(c) for c in "stmd"])
    take = np.where(long, 2, np.where(short, 1, 0))
    ok = take > 0
    mark[head[ok]] = False
    mark[head[ok] + take[ok]] = True


def bare_words(cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the scheme that drops white space and keeps each number sign apart."""
    kind, mark, starts, stops, follows = _runs(cp, ends)
    _join_contractions(cp, kind, mark, starts, stops, follows)
    mark[:-1] |= kind == NUMBER
    starts = np.flatnonzero(mark[:-1])
    stops = np.append(starts[1:], len(cp))
    keep = kind[starts] != WHITE
    return starts[keep], stops[keep]


@lru_cache(1)
def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and specials of a tokenizer file, as the merge loop wants them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids = spec["model"]["vocab"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.special.items()}
        signs = byte_signs()
        self.inner = [self.ids[s] for s in signs]
        self.last = [self.ids[s + self.suffix] for s in signs]

    def encode(self, word: str) -> list[int]:
        """Ids of one word: the contiguous rank array."""
        raw = word.encode("utf-8", "surrogatepass")
        inner, pairs = self.inner, self.merges
        parts = [inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        if len(parts) > SCANNED:
            return self._linked(parts)
        none = (1 << 60, 0)
        ranks = [pairs.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least is none:
                break
            i = ranks.index(least)
            parts[i] = least[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), none)
        return parts


    def _linked(self, parts: list[int]) -> list[int]:
        """The same merges, by a heap of (rank, position) and links between the parts that are left."""
        pairs, n = self.merges, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(*pairs[p], i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs]
        heapq.heapify(todo)
        key = lambda i: (parts[i], parts[after[i]])
        while todo:
            _, made, i, pair = heapq.heappop(todo)
            if after[i] >= n or parts[i] < 0 or key(i) != pair:
                continue  # one of its parts has gone into another
            gone = after[i]
            parts[i], parts[gone], after[i] = made, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and key(k) in pairs:
                    heapq.heappush(todo, (*pairs[key(k)], k, key(k)))
        return [p for p in parts if p >= 0]


class WordTable:
    """Entries of words met so far, by the word's 64-bit name. ``make`` gives the entries of new words.

    A word is compared with the remembered one of its name, so that two words of one name
    are told apart. The words and their signs are bounded; beyond that the table is emptied.
    """

    def __init__(self, make: Callable[[list[str]], list], bound: int = REMEMBERED, signs: int = REMEMBERED_SIGNS) -> None:
        self.make, self.bound, self.signs = make, bound, signs
        self._empty()

    def _empty(self) -> None:
        self.at: dict[int, int] = {}
        self.entries: list = []
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _add(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of new entries for words, which are remembered."""
        words = [cp[s:e].tobytes().decode("utf-32-le", "surrogatepass") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        base, size = len(self.entries), ends - starts
        self.entries.extend(self.make(words))
        while len(self.entries) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while self.used + size.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        new = slice(base, len(self.entries))
        self.begin[new], self.size[new] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : self.used + size.sum()] = cp[_spread(starts, size)]
        self.used += int(size.sum())
        return np.arange(base, len(self.entries))

    def find(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word its place in ``entries``; the table is emptied first when it is full."""
        if len(self.entries) > self.bound or self.used > self.signs:
            self._empty()
        names, first, inverse = np.unique(word_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        get = self.at.get
        places = np.fromiter((get(x, -1) for x in names.tolist()), np.int64, len(names))
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self._add(cp, starts[first[new]], ends[first[new]])
            self.at.update(zip(names[new].tolist(), places[new].tolist(), strict=True))
        places, size = places[inverse], ends - starts
        other = self.size[places] != size
        same = np.flatnonzero(~other)
        differ = cp[_spread(starts[same], size[same])] != self.flat[_spread(self.begin[places[same]], size[same])]
        if differ.any():
            other[same[np.searchsorted(np.cumsum(size[same]), np.flatnonzero(differ), "right")]] = True
        if other.any():  # words that share a name with another one
            places[other] = self._add(cp, starts[other], ends[other])
        return places


def _spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches of some sizes, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(starts - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Groups of whole texts of about CHUNK code points; a longer text is a group of its own."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > CHUNK:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def normalised(text: str) -> str:
    """Canonical composition and lower case, sign by sign as the vocabulary's normaliser does."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordCodec:
    """Encodes and decodes with a vocabulary of word ends; digests of both for whole texts."""

    def __init__(self, path: str) -> None:
        self.vocabulary = v = Vocabulary(path)
        self.special = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.table = WordTable(lambda words: [self._entry(v.encode(w)) for w in words])

    def _entry(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), " ".join(map(str, ids)).encode(), " ".join(map(self.vocabulary.tokens.__getitem__, ids)).encode()

    def _cut(self, text: str) -> list[tuple[str, int | None]]:
        """Pieces of ordinary text (normalised) and special tokens (with their ids), in order."""
        if self.special is None or not any(t in text for t in self.vocabulary.special):
            return [(normalised(text), None)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(normalised(text[at : m.start()]), None), ("", self.vocabulary.special[m[0]])]
            at = m.end()
        return [*out, (normalised(text[at:]), None)]

    def ids(self, text: str) -> list[int]:
        """Ids of one text."""
        return [int(i) for e in self.entries([text])[0] for i in e[1].split()]

    def entries(self, texts: list[str]) -> list[list[tuple[int, bytes, bytes]]]:
        """Per text the entries of its words: number of ids, the ids and the tokens, each joined by a space."""
        cut = [self._cut(t) for t in texts]
        pieces = [p for c in cut for p, _ in c]
        cp, ends = code_points(pieces)
        starts, stops = bare_words(cp, ends) if len(cp) else (np.zeros(0, np.int64),) * 2
        places = self.table.find(cp, starts, stops).tolist() if len(starts) else []
        upto = np.searchsorted(starts, ends).tolist()
        known, out, at, k = self.table.entries, [], 0, 0
        for c in cut:
            words: list = []
            for _, special in c:
                words += [known[p] for p in places[at : upto[k]]]
                at, k = upto[k], k + 1
                if special is not None:
                    words.append(self._entry([special]))
            out.append(words)
        return out

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text) of each text."""
        for group in chunks(texts):
            for words in self.entries(group):
                yield sum(w[0] for w in words), hashlib.sha256(b" ".join([w[1] for w in words])).hexdigest(), hashlib.sha256(b" ".join([w[2] for w in words])).hexdigest()


@lru_cache(2)
def codec(path: str) -> WordCodec:
    """A worker's codec of a file; worker processes are reused, so it is made once."""
    return WordCodec(path)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text.

    A null text counts as empty and has no ids; repeated rows give repeated rows; an
    empty table gives no rows; other columns are not read. No shuffle.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            n, ids, decoded = zip(*codec(path).digests(texts), strict=True) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select("doc_id", "text"), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents with the public vocabulary of word ends."""
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_bpe": op4_bpe}
