"""Repeated passages by sparse suffix arrays.

Words are what stands between ASCII white space. Of each text only the suffixes at
content-selected positions are kept: of any WINDOW consecutive starts the one whose
first SEED words hash least. Any passage of MIN_WORDS = SEED + WINDOW - 1 words
therefore keeps the same suffix wherever it stands.

The kept suffixes are range-partitioned and sorted by their first SEED words, and each is
compared with its neighbours: those that equal none are dropped. Around the others the
match is extended left and right to all windows of MIN_WORDS words that hold them. What
that gives are stretches of windows; they are sorted and compared in the same way, first
as wholes, so that copies are extended once for all of them, and then window by window.
A window counts as repeated if and only if the same MIN_WORDS words stand elsewhere too,
in another row or in the same one. Order and comparison use hashes of the words: 64 bits
choose candidates, 128 bits (and the number of words) decide.

A word that begins a hot passage is no hot key: ranges are split by place as well, and a
range's first row is compared with the last of the range before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.bpe import chunks, code_points, word_hashes
from ledgerline.llm.common import bitmap, mapped, scratch, split, stored, table

MIN_WORDS, WINDOW = 50, 18
SEED = MIN_WORDS - WINDOW + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of texts."""
    white = (cp == 32) | ((cp >= 9) & (cp <= 13))
    mark = np.zeros(len(cp) + 1, bool)
    mark[0] = True
    mark[ends] = True
    mark[1:-1] |= white[1:] != white[:-1]
    starts = np.flatnonzero(mark[:-1])
    stops = np.append(starts[1:], len(cp))
    keep = ~white[starts]
    return starts[keep], stops[keep]


class Words:
    """Hashes of the words of some texts, and of any number of consecutive words."""

    def __init__(self, texts: list[str]) -> None:
        cp, ends = code_points(texts)
        self.starts, self.stops = word_bounds(cp, ends) if len(cp) else (np.zeros(0, np.int64),) * 2
        self.first = np.searchsorted(self.starts, np.concatenate([[0], ends[:-1]])) if len(texts) else np.zeros(0, np.int64)
        self.last = np.append(self.first[1:], len(self.starts))
        self.own = _mix(word_hashes(cp, self.starts, self.stops)) if len(self.starts) else np.zeros(0, np.uint64)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _sums(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the words' hashes times powers of a base, and the inverse powers."""
        if lane not in self.sums:
            own, base = self.own if lane == 0 else _mix(self.own + np.uint64(lane)), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[lane]
            powers, inverse = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(own), b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
            self.sums[lane] = np.concatenate([[np.uint64(0)], np.cumsum(own * powers[: len(own)])]), inverse
        return self.sums[lane]

    def hashes(self, at: np.ndarray, count: int | np.ndarray, lane: int = 0) -> np.ndarray:
        """Hash of ``count`` words from each word on; equal words give equal hashes. Lanes are independent."""
        total, inverse = self._sums(lane)
        return _mix((total[at + count] - total[at]) * inverse[at] + np.uint64(0x9E3779B97F4A7C15) * np.asarray(count, np.uint64))

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of MIN_WORDS words within a text, and each one's kept suffix."""
        n = len(self.own)
        if n < MIN_WORDS:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = self.hashes(np.arange(n - SEED + 1), SEED)
        least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1) + np.arange(n - MIN_WORDS + 1)
        inside = np.zeros(n - MIN_WORDS + 1, bool)
        for s, e in zip(self.first.tolist(), (self.last - MIN_WORDS + 1).tolist(), strict=True):
            if e > s:
                inside[s:e] = True
        at = np.flatnonzero(inside)
        return at, least[at]


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, __rid, stored; it tells repeated rows apart."""
    return stored(docs.withColumn("__rid", F.monotonically_increasing_id()), "numbered")


def _suffixes(rows: DataFrame) -> DataFrame:
    """(seed, rid, pos) of the suffixes of rows (rid, text) that are kept; pos counts words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in chunks(_texts(batch)):
                w = Words(group)
                at = np.unique(w.minimisers()[1])
                of = np.searchsorted(w.last, at, "right")
                rid = batch.column("rid").take(pa.array(of + done))
                done += len(group)
                yield pa.RecordBatch.from_arrays([pa.array(w.hashes(at, SEED).view(np.int64)), rid, pa.array((at - w.first[of]).astype(np.int32))], names=["seed", "rid", "pos"])

    return mapped(rows, each, "seed long, rid long, pos int")


def _texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if t is None else t for t in batch.column("text").to_pylist()]


def neighbours(rows: DataFrame, key: list[str], place: list[str], bare: bool = False) -> DataFrame:
    """``rows`` sorted by key and place (whole numbers), with what neighbours say, stored.

    Adds ``after`` (the next row has the same key), ``before`` (the row before has) and
    that row's place, as before_<column>. Rows without such a neighbour are left out,
    unless they have a true column ``many``. ``rows`` should be stored or cheap: ranges
    are sampled first. ``bare`` leaves the key out of the result and of what is stored.
    """
    names = rows.columns
    old = [f"before_{c}" for c in place]
    many = "many" in names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, whose successor is not known yet
        first = True

        def told(part: pa.RecordBatch, last: bool, first: bool) -> pa.RecordBatch:
            """All rows of ``part`` but its last (that too at the end); the row before the first rows is in ``part``, or there is none."""
            k = [np.asarray(part.column(c)) for c in key]
            same = np.ones(max(0, part.num_rows - 1), bool)
            for x in k:
                same &= x[1:] == x[:-1]
            lead = 0 if first else 1  # a row that has been told already leads, to be compared with
            n = part.num_rows
            before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
            edge = np.zeros(n, np.int8)
            if first:
                edge[0] |= 1
            if last:
                edge[-1] |= 2
            here = np.arange(lead, n if last else n - 1)
            wanted = before[here] | after[here] | (edge[here] > 0)
            if many:
                wanted |= np.asarray(part.column("many"))[here]
            here = here[wanted]
            out = part.take(pa.array(here))
            past = [pa.array(np.where(before[here], np.asarray(part.column(c))[here - 1], 0)) for c in place]
            part_id = pa.array(np.full(len(here), TaskContext.get().partitionId(), np.int32))
            inner = pa.array(edge[here] == 0)
            cols = [pc.if_else(inner, pa.scalar(None, out.column(c).type), out.column(c)) if bare and c in key else out.column(c) for c in names]
            return pa.RecordBatch.from_arrays([*cols, pa.array(before[here]), pa.array(after[here]), *past, pa.array(edge[here]), part_id], names=[*names, "before", "after", *old, "edge", "part"])

        # held is two rows at most: one told already and the last, which waits for its successor
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if joined.num_rows - (0 if first else 1) > 1:
                yield told(joined, False, first)
                first = False
                held = joined.slice(joined.num_rows - 2)
            else:
                held = joined
        if held is not None:
            yield told(held, True, first)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "before boolean, after boolean", *(f"{o} {kinds[c]}" for o, c in zip(old, place, strict=True)), "edge byte, part int"])
    ordered = rows.repartitionByRange(*key, *place).sortWithinPartitions(*key, *place)
    found = stored(mapped(ordered, each, schema), "neighbours")
    # two rows of each range at most: their number is that of the ranges
    edges = sorted((r.part, r.edge, tuple(r[c] for c in key), tuple(r[c] for c in place)) for r in found.filter("edge > 0").select("part", "edge", *key, *place).collect())
    firsts, lasts = [e for e in edges if e[1] & 1], [e for e in edges if e[1] & 2]
    met = [(x, y) for x, y in zip(lasts, firsts[1:], strict=False) if x[2] == y[2]]
    fixed = found
    if met:
        joins = rows.sparkSession.createDataFrame([(x[0], True, False, *([0] * len(place))) for x, _ in met] + [(y[0], False, True, *x[3]) for x, y in met], "p int, next boolean, last boolean, " + ", ".join(f"p_{c} long" for c in place))
        joins = joins.groupBy("p").agg(F.max("next").alias("next"), F.max("last").alias("last"), *(F.max(F.when(F.col("last"), F.col(f"p_{c}"))).alias(f"p_{c}") for c in place))
        both = found.join(F.broadcast(joins), F.col("part") == F.col("p"), "left")
        at_first, at_last = F.col("edge").bitwiseAND(F.lit(1).cast("byte")) > 0, F.col("edge").bitwiseAND(F.lit(2).cast("byte")) > 0
        reached = F.coalesce(at_first & F.col("last"), F.lit(False))
        fixed = both.select(
            *names, (F.col("before") | reached).alias("before"), (F.col("after") | F.coalesce(at_last & F.col("next"), F.lit(False))).alias("after"),
            *(F.when(reached, F.col(f"p_{c}")).otherwise(F.col(o)).cast(kinds[c]).alias(o) for o, c in zip(old, place, strict=True)),
        )
    wanted = F.col("before") | F.col("after")
    return fixed.filter(wanted | F.col("many") if many else wanted).drop("edge", "part", *(key if bare else ()))


def _runs(marked: DataFrame) -> DataFrame:
    """(span, check, words, rid, at) of the stretches of windows around suffixes that stand elsewhere too.

    ``marked`` has rid, text and pos, the positions of those suffixes. span and check are
    hashes of the stretch's words.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, all_pos = 0, batch.column("pos")
            for group in chunks(_texts(batch)):
                w = Words(group)
                wanted = np.zeros(len(w.own) + 1, bool)
                for k in range(len(group)):
                    wanted[np.asarray(all_pos[done + k].values) + w.first[k]] = True
                at, kept = w.minimisers()
                at = at[wanted[kept]]
                of = np.searchsorted(w.last, at, "right")
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
                begin = np.flatnonzero(new)
                words = np.diff(np.append(begin, len(at))) + MIN_WORDS - 1
                rid = batch.column("rid").take(pa.array(of[begin] + done))
                done += len(group)
                cols = [*(pa.array(w.hashes(at[begin], words, lane).view(np.int64)) for lane in (0, 1)), pa.array(words.astype(np.int32)), rid, pa.array((at - w.first[of])[begin].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["span", "check", "words", "rid", "at"])

    return mapped(marked.select("rid", "text", "pos"), each, "span long, check long, words int, rid long, at int")


def _windows(asked: DataFrame) -> DataFrame:
    """(name, check, cid, i, many) of each window of the stretches ``runs`` (cid, at, words, many) of each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, runs in zip(_texts(batch), batch.column("runs").to_pylist(), strict=True):
                w = Words([text])
                size = np.array([r["words"] - MIN_WORDS + 1 for r in runs])
                i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = i + np.repeat([r["at"] for r in runs], size)
                spread = lambda c: np.repeat([r[c] for r in runs], size)  # noqa: B023, E731
                cols = [*(pa.array(w.hashes(at, MIN_WORDS, lane).view(np.int64)) for lane in (0, 1)), pa.array(spread("cid")), pa.array(i.astype(np.int32)), pa.array(spread("many"))]
                yield pa.RecordBatch.from_arrays(cols, names=["name", "check", "cid", "i", "many"])

    return mapped(asked, each, "name long, check long, cid long, i int, many boolean")


def _repeats(rows: DataFrame) -> DataFrame:
    """What :func:`repeats` gives, and rid, of rows (rid, doc_id, text) that are stored; stored as well."""
    # each step's tables go as soon as the next one is stored
    with scratch() as keep:
        suffixes = stored(_suffixes(rows), "suffixes")
        marks = stored(neighbours(suffixes, ["seed"], ["rid", "pos"], bare=True).groupBy("rid").agg(F.collect_list("pos").alias("pos")), "marks")
        # here and below, texts that are certainly in no pair are not shuffled
        marked = split(rows.select("rid", "text"), F.col("rid"), bitmap(marks.select("rid")))[0].join(marks, "rid")
        runs = keep(stored(_runs(marked).join(rows.select("rid", "doc_id"), "rid"), "runs"))
    # the classes of equal stretches: each goes on with the place where it stands first
    key, place = ["span", "check", "words"], F.struct("doc_id", "rid", "at")
    order = ["owner_id", "owner_rid", "owner_at"]
    with scratch() as keep:
        classes = stored(runs.groupBy(*key).agg(F.min(place).alias("p"), (F.count("*") > 1).alias("many")).select(*key, F.col("p.doc_id").alias("owner_id"), F.col("p.rid").alias("owner_rid"), F.col("p.at").alias("owner_at"), "many"), "classes")
        classes = keep(stored(classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("cid", F.monotonically_increasing_id()), "classes"))
    with scratch() as keep:
        asked = classes.groupBy(F.col("owner_rid").alias("rid")).agg(F.collect_list(F.struct("cid", F.col("owner_at").alias("at"), "words", "many")).alias("runs"))
        owners = split(rows.select("rid", "text"), F.col("rid"), bitmap(classes.select(F.col("owner_rid").alias("rid")).distinct()))[0]
        windows = stored(_windows(owners.join(asked, "rid").select("text", "runs")), "windows")
        found = neighbours(windows, ["name", "check"], ["cid", "i"], bare=True)
        # a class is a part of one text, so what is ordered together here is bounded by a text
        by = Window.partitionBy("cid").orderBy("i")
        last = lambda c: F.lag(c).over(by)
        goes_on = (last("i") == F.col("i") - 1) & (last("before") == F.col("before")) & (~F.col("before") | (last("before_cid") == F.col("before_cid")) & (last("before_i") == F.col("before_i") - 1))
        cut = found.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        firsts = F.min(F.struct("i", "before", "before_cid", "before_i")).alias("f")
        parts = keep(stored(cut.groupBy("cid", "part").agg(firsts, F.max("i").alias("last")).select("cid", "f.*", "last"), "parts"))
    # the first of a class has the windows' own earlier places; its copies are copies as wholes
    head = classes.select("cid", F.col("owner_id").alias("doc_id"), F.col("owner_rid").alias("rid"), F.col("owner_at").alias("at"))
    past = classes.select(F.col("cid").alias("before_cid"), F.col("owner_id").alias("past_id"), F.col("owner_at").alias("past_at"))
    own = parts.join(head, "cid").join(past, "before_cid", "left")
    start, before = F.col("at") + F.col("i"), F.col("before")
    owned = own.select("rid", "doc_id", start.alias("start"), (F.col("at") + F.col("last") + MIN_WORDS).alias("end"), F.when(before, F.col("past_id")).otherwise(F.col("doc_id")).alias("owner_id"), F.when(before, F.col("past_at") + F.col("before_i")).otherwise(start).alias("owner_start"), (~before).alias("kept"))
    again = runs.join(classes.filter("many").drop("many", "cid"), key).filter((F.col("rid") != F.col("owner_rid")) | (F.col("at") != F.col("owner_at")))
    copies = again.select("rid", "doc_id", F.col("at").alias("start"), (F.col("at") + F.col("words")).alias("end"), "owner_id", F.col("owner_at").alias("owner_start"), F.lit(False).alias("kept"))
    return stored(owned.unionAll(copies), "repeats")


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated passages: (doc_id, start, end, owner_id, owner_start, kept) in words, end exclusive.

    Each row is a stretch of windows of MIN_WORDS words that follow each other here and in
    an earlier place, the owner: by doc_id (null ids first), then by row, then by position.
    ``kept`` marks stretches whose windows stand nowhere earlier; they own themselves.
    Every repeated window lies in a stretch. Texts of fewer words, null and empty texts
    have none; repeated rows are each other's copies, and one of them keeps the passage;
    an empty table gives no rows; other columns are not read.
    """
    with scratch() as keep:
        rows = numbered(docs.select("doc_id", "text")).withColumnRenamed("__rid", "rid")
        found = keep(_repeats(rows))
    return found.drop("rid")


def cut_words(text: str, gone: list[tuple[int, int]], held: list[tuple[int, int]]) -> str:
    """The text without the words of ``gone`` that are not in ``held``; white space after a cut word goes with it."""
    cp, ends = code_points([text])
    starts, _ = word_bounds(cp, ends)
    drop = np.zeros(len(starts), bool)
    for s, e in gone:
        drop[s:e] = True
    for s, e in held:
        drop[s:e] = False
    edges = np.append(starts, len(text))
    sign = np.zeros(len(text) + 1, np.int8)
    np.add.at(sign, edges[:-1][drop], 1)
    np.add.at(sign, edges[1:][drop], -1)
    return cp[np.cumsum(sign[:-1]) == 0].tobytes().decode("utf-32-le", "surrogatepass").rstrip(" ") if drop.any() else text


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage cut out but where it stands first; n_chars follows.

    All rows and columns are kept, whatever the columns' names, so are null texts; of
    repeated rows one keeps its passages. Words that a passage kept here shares with one
    that goes stay. An empty table stays empty.
    """
    names = docs.columns
    with scratch() as keep:
        rows = keep(numbered(docs))
        found = _repeats(rows.select(F.col("__rid").alias("rid"), "doc_id", "text"))
        span = F.struct("start", "end")
        cuts = found.groupBy(F.col("rid").alias("__cut")).agg(F.collect_list(F.when(~F.col("kept"), span)).alias("__gone"), F.collect_list(F.when(F.col("kept"), span)).alias("__held"))
        cuts = keep(stored(cuts.filter(F.size("__gone") > 0), "cuts"))
        bits = keep(bitmap(cuts.select("__cut")))
    touched, whole = split(rows, F.col("__rid"), bits)
    both = touched.join(cuts, F.col("__rid") == F.col("__cut"), "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, held = batch.column("__gone").to_pylist(), batch.column("__held").to_pylist()
            texts = batch.column("text").to_pylist()
            pairs = lambda xs: [(x["start"], x["end"]) for x in xs]
            texts = [cut_words(t, pairs(g), pairs(k)) if g else t for t, g, k in zip(texts, gone, held, strict=True)]
            own = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                own["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([own.get(c, batch.column(c)) for c in names], names=names)

    columns = [F.col(f"`{c}`") for c in names]
    whole = whole.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in names else whole
    return mapped(both.select(*columns, "__gone", "__held"), each, docs.schema).unionAll(whole.select(*columns))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of MIN_WORDS words or more that stand in more than one place, in all documents."""
    return repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
