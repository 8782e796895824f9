"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint is cut into segments of 23, 23 and 18 bits. The perfect binary Golay code decodes every 23-bit word to
one codeword; a segment's own key is the index of its codeword, its keys are those of the segment and of all segments
one bit away (six at most). Of up to three differing bits, pigeonhole leaves two segments with at most one each, so of
two linked fingerprints one has its own pair of keys among the other's pairs. Fingerprints meet at these pairs,
are verified bit by bit inside a task, and leave as a spanning forest of links, never as all pairs. Pairs of keys that
very many fingerprints own are linked another exact way, through the fingerprints one and two bits away from each.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a null doc_id counts for no
component (a component of null ids alone has null); equal texts share fingerprint and component; repeated rows
stay; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm.common import fresh, stored, table
from treelake.llm.components import connected_components

#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: More owners of one pair of keys than this are linked through neighbouring fingerprints.
OWNERS = 4096
#: Rows that one task of the candidate search gets.
TASK_ROWS = 400_000
HASHES_AT_ONCE = 200_000


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def error_table() -> np.ndarray:
    """The one error of at most three bits for each of the 2048 syndromes."""
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)])
    out = np.zeros(2048, dtype=np.int64)
    out[syndrome(errors)] = errors
    return out


ERRORS = error_table()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[syndrome(words)]) >> 11


def fingerprints(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit integers."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    ends: list[int] = []
    which: list[int] = []

    def settle() -> None:
        if ends:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.array([0, *ends[:-1]])
            set_bits = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            over = set_bits * 2 > (np.array(ends) - starts)[:, None]
            out[which] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
        hashes.clear(), ends.clear(), which.clear()

    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], stops[:-1] + 1))
        if len(words) > shingle:
            starts, stops = starts[: -(shingle - 1)], stops[shingle - 1 :]
        else:
            starts, stops = starts[:1], stops[-1:]
        hashes.extend([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist())])
        ends.append(len(hashes))
        which.append(i)
        if len(hashes) >= HASHES_AT_ONCE:
            settle()
    settle()
    return out


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = fingerprints(batch["text"].to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(found)], ["doc_id", "text_key", "fp"])


def key_pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of keys of each fingerprint: (position of the fingerprint, key, whether it is its own)."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [codeword_index(p) for p in parts]
    near = [np.stack([codeword_index(p)] + [codeword_index(p ^ (1 << b)) for b in range(n)], axis=1) for p, (_, n) in zip(parts, SEGMENTS)]

    def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.sort(keys, axis=1)
        fresh = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
        rows, columns = np.nonzero(fresh)
        return rows, keys[rows, columns]

    at, keys = [], []
    sets = [distinct(k) for k in near]
    # Both segments one bit off: only the first pair needs all combinations.
    (rows0, keys0), (rows1, keys1) = sets[0], sets[1]
    counts1 = np.bincount(rows1, minlength=len(fps))
    first1 = np.cumsum(counts1) - counts1
    repeat = counts1[rows0]
    left = np.repeat(np.arange(len(rows0)), repeat)
    within = np.arange(len(left)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    at.append(rows0[left])
    keys.append(keys0[left] << 12 | keys1[first1[rows0[left]] + within])
    for kind, (a, b) in ((1, (0, 2)), (2, (1, 2))):
        rows, near_a = sets[a]
        at.append(rows)
        keys.append(kind << 24 | near_a << 12 | own[b][rows])
        rows, near_b = sets[b]
        changed = near_b != own[b][rows]
        at.append(rows[changed])
        keys.append(kind << 24 | own[a][rows[changed]] << 12 | near_b[changed])
    at, keys = np.concatenate(at), np.concatenate(keys)
    mine = [own[0] << 12 | own[1], 1 << 24 | own[0] << 12 | own[2], 2 << 24 | own[1] << 12 | own[2]]
    kind = keys >> 24
    return at, keys, np.choose(kind, [m[at] for m in mine]) == keys


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) to (key, fp, own)."""
    for batch in batches:
        fps = batch["fp"].to_numpy().view(np.uint64)
        for start in range(0, len(fps), 2000):
            at, keys, own = key_pairs(some := fps[start : start + 2000])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[at].view(np.int64)), pa.array(own)], ["key", "fp", "own"])


def close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def links_of_group(fps: np.ndarray, own: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between owners and members of one key."""
    group = np.arange(len(fps))
    out = []
    for i in np.flatnonzero(own):
        others = np.unique(group[close(fps, fps[i], bits)])
        if len(others) > 1:
            target = others[0]
            for other in others[1:]:
                out.append((target, other))
            group[np.isin(group, others)] = target
    return out


def link_rows(bits: int):
    """Task function: (key, fp, own) of whole keys to links (a, b); the rows of a task are few (TASK_ROWS)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["key"].to_numpy(), b["fp"].to_numpy().view(np.uint64), b["own"].to_numpy(zero_copy_only=False)) for b in batches]
        if not held:
            return
        keys, fps, own = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, fps, own = keys[order], fps[order], own[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        of_row = np.repeat(sizes, sizes)
        pairs_a, pairs_b = [], []
        for shift in range(1, 16):  # small groups: each member against the next ones
            pair = (of_row[:-shift] <= 16) & (keys[:-shift] == keys[shift:]) & (own[:-shift] | own[shift:])
            i = np.flatnonzero(pair)
            i = i[close(fps[i], fps[i + shift], bits)]
            pairs_a.append(fps[i])
            pairs_b.append(fps[i + shift])
        for start, size in zip(starts[sizes > 16], sizes[sizes > 16]):
            members = fps[start : start + size]
            if found := links_of_group(members, own[start : start + size], bits):
                a, b = np.array(found).T
                pairs_a.append(members[a])
                pairs_b.append(members[b])
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        for start in range(0, len(both), 100_000):
            some = both[start : start + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], ["a", "b"])

    return task


def neighbour_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) to (hub, fp, near): every fingerprint at most one bit (near) or two bits away."""
    one = [0] + [1 << i for i in range(64)]
    two = [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    masks, near = np.array(one + two, dtype=np.uint64), np.arange(len(one) + len(two)) < len(one)
    for batch in batches:
        fps = batch["fp"].to_numpy().view(np.uint64)
        for fp in fps:
            hubs = (fp ^ masks).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hubs), pa.array(np.full(len(hubs), fp).view(np.int64)), pa.array(near)], ["hub", "fp", "near"])


def links_through_hubs(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect fingerprints up to three bits apart: one is one bit from a hub, the other two."""
    rows = fps.select("fp").mapInArrow(neighbour_rows, "hub long, fp long, near boolean")
    centres = rows.filter("near").groupBy("hub").agg(F.min("fp").alias("centre"))
    return rows.join(stored(centres, "simhash-hubs"), "hub").filter("fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()


def links(fps: DataFrame, bits: int = 3, owners: int = OWNERS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints at most bits (up to 3) apart."""
    if bits > 3:
        raise ValueError("three segments find at most three differing bits")
    rows = fps.mapInArrow(key_rows, "key long, fp long, own boolean")
    crowded = stored(rows.filter("own").groupBy("key").count().filter(F.col("count") > owners).select("key"), "simhash-crowded")
    more = None
    if bits == 3 and not crowded.isEmpty():
        more = links_through_hubs(rows.join(crowded, "key").select("fp").distinct())
        rows = rows.join(crowded, "key", "left_anti")
    parts = max(1, -(-fps.count() * 50 // TASK_ROWS))
    found = rows.repartition(parts, "key").mapInArrow(link_rows(bits), "a long, b long")
    return found if more is None else found.unionByName(more)


def rooted(docs: DataFrame, bits: int = 3, owners: int = OWNERS) -> DataFrame:
    """doc_id, text_key (digest of the text), fingerprint, component_id and root of every row; root, a fingerprint, names the component."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    prints = stored(rows.mapInArrow(fingerprint_rows, "doc_id long, text_key long, fp long"), "simhash-prints")
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(links(first.select("fp"), bits, owners)).withColumnRenamed("node", "fp")
    named = stored(first.join(roots, "fp"), "simhash-named")
    least = stored(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    linked = stored(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "simhash-linked")
    ids = first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints.join(stored(ids, "simhash-ids"), "fp").select("doc_id", "text_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def near_dedup(docs: DataFrame, bits: int = 3, owners: int = OWNERS) -> DataFrame:
    """doc_id, text_key (digest of the text), fingerprint, component_id of every row."""
    return rooted(docs, bits, owners).drop("root")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of docs: that with the smallest doc_id, and of one id the smallest digest."""
    rows = rooted(docs).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "rows")).alias("least")
    kept = stored(rows.groupBy("root").agg(least).select(F.col("least.doc_id").alias("kept_id"), F.col("least.text_key").alias("kept_key"), F.col("least.rows").alias("rows")), "simhash-kept")
    same = (F.xxhash64(docs["text"]) == kept["kept_key"]) & docs["doc_id"].eqNullSafe(kept["kept_id"])
    found = docs.join(kept.select("kept_key", "kept_id"), same, "left_semi")
    if kept.filter("rows > 1").isEmpty():
        return found
    name = fresh(docs, "kept_key")
    return found.withColumn(name, F.xxhash64("text")).dropDuplicates(["doc_id", name]).drop(name)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {"op10_simhash": op10}
SQL: dict[str, str] = {}
