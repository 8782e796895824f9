"""Substring dedup with prefix-partitioned suffix trees.

Only sampled suffixes are shuffled: those that start at the GRAM-word gram with the smallest digest of some window of WINDOW
words. Equal windows have their sample at the same place, and neighbouring windows share one, so a run of windows goes
with its sample as one stretch of words. A group is the stretches whose sampled suffix has the same prefix of GRAM words;
prefixes seen at one place only cannot repeat and are left out before any text moves. Equal stretches are one, found by
grouping on the words themselves. A group of at most GROUP distinct stretches is gathered with others into a task, which
sorts the suffixes of its stretches to depth WINDOW: the ranks of the last doubling are the subtrees' internal nodes of at
least that depth, over words, not digests. Where a prefix has more stretches it is lengthened to the whole window: Spark
groups on its words, and nothing is gathered. The union of those nodes' windows is the union of the maximal repeats of at
least WINDOW words, the same document included.

Digests name prefixes, which only decides what meets; what is removed is equal word by word. Texts and stretches are named
by 128 bits of SHA-256 and BLAKE2b. Equal texts are one content with several rows: their windows repeat by that alone,
and count once against others.

Defined results: a null text counts as empty, has no words and keeps the empty text; texts shorter than a window
lose nothing; very long texts are read whole; repeated rows are copies of each other; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm.common import rows_about, stored, table

WINDOW, GRAM = 35, 8
#: Distinct stretches of a prefix beyond which it is lengthened to the whole window.
GROUP = 2000
#: Stretches of gathered groups per task.
TASK_ROWS = 50_000
#: Rows whose marks are Python objects at once.
ROWS_AT_ONCE = 500
#: Bytes of text read at once, unless one text is longer.
BYTES_AT_ONCE = 1 << 20
#: Bits of a word's number within a text; a Spark string has fewer than 2 to the 31 bytes.
PLACE_BITS = 32
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240101)
BYTE_VALUES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2 to the 64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        held = _POWERS[base] = np.cumprod(factors)
        if n > 4 * BYTES_AT_ONCE:
            _POWERS.pop(base)
    return held[:n]


def ranges_digest(values: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> np.ndarray:
    """Polynomial digests of values[low:high], from running sums and the inverse of the base."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(values)))))
    inverse = pow(base, -1, 1 << 64)
    return mix((sums[high] - sums[low]) * powers(inverse, len(values) + 1)[low])


class Texts:
    """Word digests, sampled suffixes and prefix digests of some texts at once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = SPACES[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        starts = np.flatnonzero(~space & (first[:-1] | np.concatenate(([True], space[:-1]))))
        ends = np.flatnonzero(~space & (first[1:] | np.concatenate((space[1:], [True])))) + 1
        self.words = ranges_digest(BYTE_VALUES[data], starts, ends, BASES[0])
        self.of = np.searchsorted(offsets, starts, side="right") - 1
        self.first = np.searchsorted(starts, offsets[:-1])
        n = len(self.words)
        self.at = np.arange(max(0, n - WINDOW + 1))
        self.at = self.at[self.of[self.at] == self.of[self.at + WINDOW - 1]] if n >= WINDOW else self.at[:0]
        if len(self.at):
            grams = np.arange(n - GRAM + 1)
            self.grams = ranges_digest(self.words, grams, grams + GRAM, BASES[1])
            low = np.uint64((1 << PLACE_BITS) - 1)
            least = (self.grams & ~low) | grams.astype(np.uint64)
            reach, width = 1, WINDOW - GRAM + 1
            while reach * 2 <= width:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
            self.owner = (least[self.at] & low).astype(np.int64)
            new = np.concatenate(([True], (self.owner[1:] != self.owner[:-1]) | (self.at[1:] != self.at[:-1] + 1)))
            self.runs = np.flatnonzero(new)
        else:
            self.grams, self.owner, self.runs = np.zeros(0, np.uint64), self.at, self.at

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each run of windows with one sample: text, first window within the text, number of windows, prefix digest."""
        at = self.at[self.runs]
        counts = np.diff(np.append(self.runs, len(self.at)))
        return self.of[at], at - self.first[self.of[at]], counts, self.grams[self.owner[self.runs]]


def some_texts(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """The texts of a column, about BYTES_AT_ONCE at a time: (position of the first, texts)."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BYTES_AT_ONCE, side="right")) - 1)
        stop = min(stop, len(column))
        yield start, Texts(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        start = stop


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ka, kb, text) to (gram, ka, kb, first, windows) for every run of windows."""
    for batch in batches:
        ka, kb = batch["ka"].to_numpy(), batch["kb"].to_numpy()
        for start, texts in some_texts(batch["text"]):
            of, first, windows, gram = texts.anchors()
            columns = [pa.array(gram.view(np.int64)), pa.array(ka[start + of]), pa.array(kb[start + of]), pa.array(first.astype("i4")), pa.array(windows.astype("i4"))]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "ka", "kb", "first", "windows"])


def stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ka, kb, text, marks) to (gram, ka, kb, first, windows, ca, cb, stretch) for the marked runs; ca and cb name the stretch."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(start, ROWS_AT_ONCE)
            row, grams, firsts, windows, names, stretches = [], [], [], [], [], []
            for i, (text, marks) in enumerate(zip(some["text"], some["marks"])):
                words = text.as_py().encode().split()
                for mark in marks.as_py():
                    stretch = b" ".join(words[mark["first"] : mark["first"] + mark["windows"] + WINDOW - 1])
                    row.append(i)
                    grams.append(mark["gram"])
                    firsts.append(mark["first"])
                    windows.append(mark["windows"])
                    names.append(hashlib.blake2b(stretch, digest_size=16).digest())
                    stretches.append(stretch)
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            row = pa.array(row, pa.int32())
            columns = [pa.array(grams, pa.int64()), some["ka"].take(row), some["kb"].take(row), pa.array(firsts, pa.int32()), pa.array(windows, pa.int32())]
            columns += [pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(stretches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "ka", "kb", "first", "windows", "ca", "cb", "stretch"])


def deep_ranks(words: np.ndarray) -> np.ndarray:
    """Rank of each suffix of words among all, by its first WINDOW words: sorted by doubled prefixes of ranks."""
    rank, depth = words.astype(np.int64), 1
    while depth < WINDOW:
        step = min(depth, WINDOW - depth)
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1]
        depth += step
    return rank


def subtree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of whole groups to (ca, cb, mask): bit i of mask tells that window i is a leaf of a deep internal node."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    gathered = pa.Table.from_batches(held)
    stretches = gathered["stretch"].combine_chunks().cast(pa.large_binary())
    lists = pc.split_pattern(stretches, b" ")
    words = lists.flatten().dictionary_encode().indices.to_numpy()
    counts = pc.list_value_length(lists).to_numpy()
    starts = np.cumsum(counts) - counts
    rank = deep_ranks(words)
    windows = counts - WINDOW + 1
    row = np.repeat(np.arange(len(counts)), windows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    leaves = rank[starts[row] + place]
    node = np.bincount(leaves)[leaves] > 1
    mask = np.zeros(len(counts), np.int64)
    np.bitwise_or.at(mask, row[node], np.int64(1) << place[node])
    hit = pa.array(np.flatnonzero(mask))
    yield pa.RecordBatch.from_arrays([gathered["ca"].take(hit).combine_chunks(), gathered["cb"].take(hit).combine_chunks(), pa.array(mask[mask != 0])], ["ca", "cb", "mask"])


def leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of split groups to one row per window: (window, ca, cb, place)."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(start, ROWS_AT_ONCE)
            row, windows, places = [], [], []
            for i, stretch in enumerate(some["stretch"].to_pylist()):
                words = stretch.split(b" ")
                for place in range(len(words) - WINDOW + 1):
                    row.append(i)
                    windows.append(b" ".join(words[place : place + WINDOW]))
                    places.append(place)
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), some["ca"].take(row), some["cb"].take(row), pa.array(places, pa.int32())], ["window", "ca", "cb", "place"])


def kept_words(text: str | None, marks: list[dict] | None, copied: bool) -> tuple[list[bytes], int]:
    """Words that stay and number of all words."""
    words = (text or "").encode().split()
    if copied and len(words) >= WINDOW:
        return [], len(words)
    if not marks:
        return words, len(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for mark in marks:
        mask, at = mark["mask"], mark["first"]
        while mask:
            if mask & 1:
                edges[at] += 1
                edges[at + WINDOW] -= 1
            mask, at = mask >> 1, at + 1
    gone = np.cumsum(edges)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], len(words)


def split_groups(stretches: DataFrame) -> DataFrame:
    """(ca, cb, mask) of distinct stretches whose prefix is lengthened to the whole window: one with two places is a node."""
    leaves = stretches.select("ca", "cb", "stretch").mapInArrow(leaf_rows, "window binary, ca long, cb long, place int")
    nodes = stored(leaves.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window"), "substring-nodes", compression="zstd")
    return leaves.join(nodes, "window").groupBy("ca", "cb").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))


def repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """ka, kb, copied, marks of every content with repeated windows: marks are (first, mask) of runs of windows."""
    rows = docs.select("ka", "kb", "doc_id", "text")
    contents = stored(rows.groupBy("ka", "kb").agg(F.count("*").alias("rows"), F.min("doc_id").alias("one")), "substring-contents")
    anchors = rows.select("ka", "kb", "text").mapInArrow(anchor_rows, "gram long, ka long, kb long, first int, windows int")
    anchors = stored(anchors, "substring-anchors")
    place = F.xxhash64("ka", "kb", "first")
    grams = anchors.groupBy("gram").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("gram")
    marks = anchors.join(stored(grams, "substring-grams"), "gram").groupBy("ka", "kb").agg(F.collect_set(F.struct("first", "windows", "gram")).alias("marks"))
    marks = stored(marks.join(contents, ["ka", "kb"]).select("ka", "kb", F.col("one").alias("doc_id"), "marks"), "substring-marks")
    same = [rows[c].eqNullSafe(marks[c]) for c in ("ka", "kb", "doc_id")]
    one = rows.join(marks, same).select(rows["ka"], rows["kb"], "text", "marks")  # a content's copies spread by doc_id
    runs = one.mapInArrow(stretch_rows, "gram long, ka long, kb long, first int, windows int, ca long, cb long, stretch binary")
    runs = stored(runs, "substring-runs", compression="zstd")
    # A content brought by several rows of one doc_id has its places several times, hence not their count.
    distinct = runs.groupBy("gram", "ca", "cb", "stretch").agg((F.min(place) != F.max(place)).alias("copied"))
    distinct = stored(distinct, "substring-stretches", compression="zstd")
    large = distinct.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("gram", F.lit(True).alias("large"))
    once = distinct.join(stored(large, "substring-large"), "gram", "left")
    small = once.filter("large is null")
    found = small.repartition(rows_about(distinct, TASK_ROWS), "gram").select("ca", "cb", "stretch").mapInArrow(subtree_rows, "ca long, cb long, mask long")
    found = found.unionByName(split_groups(once.filter("large")))
    whole = distinct.filter("copied").select("ca", "cb", F.lit(-1).cast("long").alias("mask"))
    masks = stored(found.unionByName(whole).groupBy("ca", "cb").agg(F.bit_or("mask").alias("mask")), "substring-masks")
    found = runs.select("ca", "cb", "ka", "kb", "first", "windows").join(masks, ["ca", "cb"])
    found = found.withColumn("mask", F.expr("mask & (shiftleft(1L, windows) - 1)"))
    found = found.groupBy("ka", "kb").agg(F.collect_set(F.struct("first", "mask")).alias("marks"))
    copied = contents.filter("rows > 1").select("ka", "kb", F.lit(True).alias("copied"))
    both = found.join(copied, ["ka", "kb"], "full")
    return stored(both.select("ka", "kb", F.coalesce("copied", F.lit(False)).alias("copied"), "marks"), "substring-repeats")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sha = F.unhex(F.sha2(text, 256))
    half = lambda at: F.conv(F.hex(F.substring(sha, at, 8)), 16, -10).cast("long")
    return docs.select("doc_id", text.alias("text"), half(1).alias("ka"), half(9).alias("kb"))


def with_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, text, copied, marks of every row."""
    rows = keyed(docs)
    return rows.join(repeats(rows, group), ["ka", "kb"], "left").select("doc_id", "text", "copied", "marks")


def dedup(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, text of every row: the words that stay, joined by one space."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b" ".join(kept_words(*x)[0]).decode() for x in zip(*(batch[c].to_pylist() for c in ("text", "marks", "copied")))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(kept, pa.string())], ["doc_id", "text"])

    rows = with_repeats(docs, group)
    return rows.mapInArrow(task, rows.select("doc_id", "text").schema)


def digests(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, shas = [], [], []
            for x in zip(*(batch[c].to_pylist() for c in ("text", "marks", "copied"))):
                kept, n = kept_words(*x)
                counts.append(n)
                removed.append(n - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = with_repeats(docs.withColumn("doc_id", F.col("doc_id").cast("long")), group)
    return rows.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op3_substring_dedup": op3}
SQL: dict[str, str] = {}
