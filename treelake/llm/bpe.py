"""Byte-level BPE encoding and decoding with a pair occurrence index.

Each task reads its texts in slices of about SLICE characters, cuts them into pieces as Arrow strings and gathers the words of pieces
that a slice brings anew. Their bytes are one list of symbols; an index maps each mergeable pair, by its rank, to all its positions
there. Active ranks are applied in ascending order, each at all its positions, and each merge enters only the pairs beside the new
symbols into the lists of their ranks. Texts are then put together from the pieces' ids. What is remembered between slices is bounded
in bytes. All bounds are small, since a worker keeps its memory while it waits and while other stages run beside it on the same executor.

Defined results: a null text counts as empty and has no tokens; strings of added tokens in a text become their ids, as
in the tokenizers library; very long texts are encoded whole, span by span; repeated rows and ties give equal rows; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm.common import table

#: Fixed value: the published splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that the pattern takes as one word: Latin letters, also in Arrow's expressions.
ONE_WORD = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
#: Characters of texts encoded together, and of a span of a longer text.
SLICE, SPAN = 2 << 20, 1 << 20
#: Bytes of words whose pairs are in one index.
INDEXED = 1 << 18
#: Bytes of remembered pieces and their ids.
REMEMBERED = 16 << 20
#: Tokens decoded at once.
TOKENS = 1 << 18
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable, else the next above 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def bytes_and_ends(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of an array of strings or binary values, and where each value ends in them, after a first 0."""
    if not len(column):
        return memoryview(b""), np.zeros(1, np.int32)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return memoryview(data or b"")[ends[0] : ends[-1]], ends - ends[0]


def values(kind: pa.DataType, data: bytes | memoryview, ends: np.ndarray) -> pa.Array:
    """Strings or binary values from their bytes and where they end, after a first 0."""
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.array(ends).cast(pa.int32()).buffers()[1], pa.py_buffer(data)])


class Remembered:
    """Packed ids of pieces, of bounded bytes: when they are too many, the older half is forgotten but for those just used."""

    def __init__(self, most: int):
        self.most, self.pieces, self.ids = most, pa.array([], pa.string()), pa.array([], pa.binary())

    def rows(self, pieces: pa.Array) -> np.ndarray:
        """The row of each of some distinct pieces here; -1 if it has none."""
        found = pc.fill_null(pc.index_in(self.pieces, value_set=pieces), -1).to_numpy()
        here, rows = np.flatnonzero(found >= 0), np.full(len(pieces), -1)
        rows[found[here]] = here
        return rows

    def add(self, pieces: pa.Array, ids: pa.Array, used: np.ndarray) -> None:
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.ids = pa.concat_arrays([self.ids, ids])
        if self.pieces.nbytes + self.ids.nbytes > self.most:
            stays = np.arange(len(self.pieces)) >= len(self.pieces) // 2
            stays[used] = True
            self.pieces, self.ids = (x.filter(pa.array(stays)) for x in (self.pieces, self.ids))


class ByteBpe:
    """A byte-level BPE vocabulary; pieces of texts are remembered up to so many bytes."""

    def __init__(self, file: bytes, remembered: int = REMEMBERED, slice_size: int = SLICE, span: int = SPAN):
        said = json.loads(file)
        vocab, merges = said["model"]["vocab"], said["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        bytes_of = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            bytes_of[i] = token.encode()
        self.bytes_of = pa.array(bytes_of, pa.binary())
        self.first_of = np.array([*(vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])), -1], np.int32)
        self.pairs = np.array([(vocab[a], vocab[b]) for a, b in merges])
        self.made = np.array([vocab[a + b] for a, b in merges])
        keys, ranks = np.unique(self.pairs[:, 0] << 20 | self.pairs[:, 1], return_index=True)
        self.sorted_keys, self.sorted_ranks = np.append(keys, 1 << 62), np.append(ranks, len(merges))
        self.split_words = regex.compile(PATTERN).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else None
        self.safe = regex.compile(r"(?<=\S)(?<![\x1c-\x1f])(?= )").search
        self.first_ranks = self.ranks(np.repeat(self.first_of, 257), np.tile(self.first_of, 257)).astype(np.int32)
        self.remembered, self.slice_size, self.span = Remembered(remembered), slice_size, span

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; the number of merges if it does not merge. Word ends are negative symbols."""
        keys = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.sorted_keys, keys)
        return np.where((self.sorted_keys[at] == keys) & (left >= 0) & (right >= 0), self.sorted_ranks[at], len(self.made))

    def encode_words(self, words: pa.Array) -> pa.Array:
        """Packed ids of each word, by the index of pair occurrences over about INDEXED bytes of them."""
        _, ends = bytes_and_ends(words)
        parts, start = [], 0
        while start < len(words):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + INDEXED)))
            parts.append(self.encode_together(words.slice(start, stop - start)))
            start = stop
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def encode_together(self, words: pa.Array) -> pa.Array:
        data, ends = bytes_and_ends(words)
        ends = ends[1:] + np.arange(1, len(words) + 1)
        first = np.full(len(data) + len(words) + 1, 256, np.int32)
        inside = np.ones(len(first), bool)
        inside[0] = inside[ends] = False
        first[inside] = np.frombuffer(data, np.uint8)
        symbols = self.first_of[first]
        after, before = (np.arange(i, len(symbols) + i, dtype=np.int32) for i in (1, -1))
        after[-1], never = len(symbols) - 1, len(self.made)
        merged = np.zeros(len(symbols), bool)

        # The index: positions of the first pairs by rank, and those that merges add.
        rank = self.first_ranks[first[:-1] * 257 + first[1:]]
        order = np.argsort(rank, kind="stable")
        order = order[: np.searchsorted(rank[order], never)]
        active, at = np.unique(rank[order], return_index=True)
        places = dict(zip(active.tolist(), np.split(order, at[1:]))) if len(active) else {}
        more: dict[int, list[int]] = {}
        active = active.tolist()
        heapq.heapify(active)
        while active:
            now = heapq.heappop(active)
            i = places.pop(now, None)
            if new := more.pop(now, None):
                i = np.array(new) if i is None else np.concatenate((i, new))
            (a, b), made = self.pairs[now].tolist(), self.made[now]
            j = after[i]
            fits = (symbols[i] == a) & (symbols[j] == b)
            if a == b:  # of overlapping pairs every other one, from the left
                i = np.sort(i[fits])
                i = np.array(every_other(i.tolist(), after[i].tolist()), np.int64)
            else:
                i = i[fits]
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            symbols[i], symbols[j], after[i], before[k] = made, -2, k, i
            h = before[i]
            merged[i] = True
            alone = ~merged[k]  # else the pair is that on the left of the next merge
            merged[i] = False
            i, k = i[alone], k[alone]
            where = np.concatenate((h, i))
            found = self.ranks(symbols[where], np.concatenate((np.full(len(h), made), symbols[k])))
            which = found < never
            for r, place in zip(found[which].tolist(), where[which].tolist()):
                if r in more:
                    more[r].append(place)
                else:
                    more[r] = [place]
                    if r not in places:
                        heapq.heappush(active, r)
        live = symbols >= 0
        return values(pa.binary(), symbols[live].astype("<u4").tobytes(), np.cumsum(live)[np.concatenate(([0], ends))] * 4)

    def learned(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Packed ids, and the row there of each of some distinct pieces."""
        rows = self.remembered.rows(pieces)
        known, fresh = rows[rows >= 0], np.flatnonzero(rows < 0)
        rows[rows >= 0] = np.arange(len(known))
        new = pieces.take(pa.array(fresh))
        one = pc.match_substring_regex(new, ONE_WORD).to_numpy(zero_copy_only=False)
        order = np.concatenate((np.flatnonzero(one), np.flatnonzero(~one)))
        split = [self.split_words(p) for p in new.filter(pa.array(~one)).to_pylist()]
        counts = np.concatenate((np.ones(one.sum(), int), np.fromiter(map(len, split), int, len(split))))
        words = pa.concat_arrays([new.filter(pa.array(one)), pa.array(list(chain.from_iterable(split)), pa.string())]).dictionary_encode()
        del split

        its_rows = self.remembered.rows(words.dictionary)
        unknown = np.flatnonzero(its_rows < 0)
        known = np.concatenate((known, its_rows[its_rows >= 0]))
        its_rows[its_rows >= 0] = np.arange(len(known) - len(its_rows) + len(unknown), len(known))
        its_rows[unknown] = np.arange(len(known), len(known) + len(unknown))
        unknown = words.dictionary.take(pa.array(unknown))
        encoded = self.encode_words(unknown)
        ids = pa.concat_arrays([self.remembered.ids.take(pa.array(known)), encoded])
        its_rows = its_rows[words.indices.to_numpy()]

        # A piece of one word has the word's row, the others have rows of their own.
        several = counts != 1
        data, ends = bytes_and_ends(ids.take(pa.array(its_rows[np.repeat(several, counts)])))
        joined = values(pa.binary(), data, ends[np.concatenate(([0], np.cumsum(counts[several])))])
        found = np.empty(len(new), int)
        found[~several] = its_rows[(np.cumsum(counts) - counts)[~several]]
        found[several] = len(ids) + np.arange(len(joined))
        rows[fresh[order]] = found
        self.remembered.add(pa.concat_arrays([unknown, new.take(pa.array(order[several]))]), pa.concat_arrays([encoded, joined]), known)
        return pa.concat_arrays([ids, joined]), rows

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pieces whose words are those of the texts, cut before spaces that follow no white space, and how many each text has."""
        parts = [t.encode() for t in texts]
        data = b"".join(parts)
        starts = np.cumsum([0, *map(len, parts)])
        found = np.frombuffer(data, np.uint8)
        space = np.flatnonzero(found == 32)
        space = space[space > 0]
        last, before = found[space - 1], found[space - 2]  # not looked at for a text's first space
        plain = (last > 32) & (last < 128) | (last < 9) | (last > 13) & (last < 28)
        # White space beyond ASCII: the first of its last two bytes in UTF-8 is among these.
        plain |= (last >= 128) & ~np.isin(before, (0x80, 0x81, 0x9A, 0xC2))
        here = np.zeros(len(data) + 1, bool)
        here[space[plain]] = here[starts] = True
        cuts = np.flatnonzero(here)
        return values(pa.string(), data, cuts), np.diff(np.searchsorted(cuts, starts))

    def spans(self, text: str) -> Iterator[str]:
        """A text in spans of about equal length, cut where it may be."""
        start = 0
        while len(text) - start > self.span and (m := self.safe(text, start + self.span)):
            yield text[start : m.start()]
            start = m.start()
        yield text[start:]

    def parts(self, text: str) -> Iterator[bytes | str]:
        """A text as packed ids of added tokens and spans of what is between them."""
        for part in self.split_added(text) if self.split_added and any(a in text for a in self.added) else [text]:
            if part in self.added:
                yield self.added[part].to_bytes(4, "little")
            elif part:
                yield from self.spans(part)

    def encode_spans(self, spans: list[str]) -> list[memoryview]:
        """Packed ids of each span."""
        pieces, counts = self.cut(spans)
        pieces = pieces.dictionary_encode()
        ids, rows = self.learned(pieces.dictionary)
        data, ends = bytes_and_ends(ids.take(pa.array(rows[pieces.indices.to_numpy()])))
        ends = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        pa.default_memory_pool().release_unused()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        held, spans, size, begun = [], [], 0, []

        def settle() -> Iterator[bytes]:
            nonlocal held, spans, size, begun
            ids = self.encode_spans(spans) if spans else []
            for part in held:
                if part is None:  # the end of a text
                    yield b"".join(begun)
                    begun = []
                else:
                    begun.append(bytes(ids[part]) if isinstance(part, int) else part)
            held, spans, size = [], [], 0

        for text in texts:
            for part in self.parts(text):
                if isinstance(part, str):
                    held.append(len(spans))
                    spans.append(part)
                else:
                    held.append(part)
                size += len(part)
                if size >= self.slice_size:
                    yield from settle()
            held.append(None)
        yield from settle()

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        ids = pa.array(np.frombuffer(ids, "<u4"))
        return b"".join([bytes_and_ends(self.bytes_of.take(ids.slice(i, TOKENS)))[0] for i in range(0, len(ids), TOKENS)]).decode("utf-8", "replace")


def every_other(places: list[int], following: list[int]) -> list[int]:
    """Of sorted places, those that no chosen place before them overlaps."""
    out, taken = [], -1
    for place, after in zip(places, following):
        if place != taken:
            out.append(place)
            taken = after
    return out


_LOADED: dict[str, ByteBpe] = {}


def loader(spark: SparkSession, path: str) -> Callable[[], ByteBpe]:
    """A function for tasks that returns the vocabulary of the file at path, read once on the driver."""
    with open(path, "rb") as file:
        content = file.read()
    key, shared = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    def load() -> ByteBpe:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = ByteBpe(shared.value)
        return _LOADED[key]

    return load


def texts_of(column: pa.Array) -> Iterator[str]:
    for i in range(0, len(column), 64):
        yield from (t or "" for t in column.slice(i, 64).to_pylist())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    load = loader(docs.sparkSession, path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype("i4") for x in load().encode(texts_of(batch["text"]))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids)."""
    load = loader(encoded.sparkSession, path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [load().decode(np.array(x or [], "<u4").tobytes()) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every row in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    load = loader(docs.sparkSession, path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = load()
            found = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(model.decode(x).encode()).hexdigest()) for x in model.encode(texts_of(batch["text"]))]
            columns = [batch["doc_id"], *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, DIGESTS)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op2_bpe": op2}
SQL: dict[str, str] = {}
