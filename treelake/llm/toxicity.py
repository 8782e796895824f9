"""Toxicity with a linear-chain conditional random field over words.

Labelled words come from labelled documents: words that toxic documents hold far more often than clean ones are
labelled toxic where a toxic document has them. A field with two states is fitted to windows of labelled words;
forward-backward marginals of all words of a document aggregate to its score, and words with a high marginal to spans.

The fit sees a bounded sample: the PER_CLASS[label] documents of each label with the smallest hash of their id, among
labelled documents whose crc32(doc_id as text) mod 5 is not 0 and whose texts have at most SAMPLE_CHARS code points; at most
STRETCHES windows of each. Scoring reads every whole text, however long, and nothing else.

Defined results: a null text counts as empty; a text without words gets the score of no evidence; without labelled rows of
both kinds every score is the share of toxic labels seen (0 if none); repeated rows and equal texts get equal scores; rows
that repeat a labelled id are sampled by the hash of their text; a score of exactly the threshold counts as toxic; offsets are
code points of the text as it is; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm.common import table

#: Most documents of the fitting sample: clean, toxic.
PER_CLASS = (4000, 2500)
#: Most words of a window, and of all windows of the sample.
WINDOW, SAMPLE_WORDS = 48, 400_000
#: Most windows of a document in the sample, and most code points of a document there.
STRETCHES, SAMPLE_CHARS = 7, 50_000
#: Words whose marginals are held at once.
WORDS_AT_ONCE = 300_000
HASH_BITS = 19
BLOCK = 64
WORD = re.compile(r"\w+")


def lower_words(text: str) -> list[str]:
    """The words of a text in lower case, as many as it has; lower case may be longer than the text."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def features(word: str) -> tuple[int, int, int]:
    """Hashed features of a word: itself, its beginning and its end."""
    mask = (1 << HASH_BITS) - 1
    return zlib.crc32(b"w" + word.encode()) & mask, zlib.crc32(b"p" + word[:6].encode()) & mask, zlib.crc32(b"s" + word[-5:].encode()) & mask


def toxic_words(texts: list[list[str]], labels: np.ndarray) -> set[str]:
    """Words far more frequent in toxic documents, by the log odds of document frequencies and their deviation."""
    seen = (Counter(), Counter())
    for words, label in zip(texts, labels):
        seen[label].update(set(words))
    clean, toxic = (labels == 0).sum(), (labels == 1).sum()
    out = set()
    for word, a in seen[1].items():
        if a >= 3:
            b = seen[0][word]
            odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
            if odds > 1.2 and odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > 3:
                out.add(word)
    return out


def chain(emit: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages and log-normalisers of padded rows; emit is the log odds of state 1, move 2 x 2 log."""
    rows, length = emit.shape
    trans, odds = np.exp(move), np.exp(np.clip(emit, -30, 30))
    forward, backward, norm = np.ones((length, rows, 2)), np.ones((length, rows, 2)), np.zeros(rows)
    now = np.full((rows, 2), 0.5)
    for t in range(length):
        new = now if t == 0 else now @ trans
        new = new * np.stack([np.ones(rows), odds[:, t]], axis=1)
        total = new.sum(axis=1, keepdims=True)
        live = mask[:, t : t + 1]
        norm += np.log(total[:, 0]) * live[:, 0]
        now = np.where(live, new / total, now)
        forward[t] = now
    now = np.ones((rows, 2))
    for t in range(length - 1, 0, -1):
        backward[t] = now
        new = (now * np.stack([np.ones(rows), odds[:, t]], axis=1)) @ trans.T
        now = np.where(mask[:, t : t + 1], new / new.sum(axis=1, keepdims=True), now)
    backward[0] = now
    return forward, backward, norm


@dataclass
class Field:
    """Weights of hashed features, log transitions, and the calibration from marginals to a document's score."""

    weights: np.ndarray
    move: np.ndarray
    scale: np.ndarray
    constant: float | None = None
    known: dict[str, float] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = float(sum(self.weights[i] for i in features(w)))
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Probability of the toxic state at each word; long texts run in blocks whose messages are joined exactly."""
        counts = [len(t) for t in texts]
        blocks = np.array([-(-n // BLOCK) for n in counts])
        first = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        if not total:
            return [np.zeros(0) for _ in texts]
        odds, live = np.ones((total, BLOCK)), np.zeros((total, BLOCK), bool)
        for i, words in enumerate(texts):
            if words:
                at = slice(first[i] * BLOCK, first[i] * BLOCK + len(words))
                odds.reshape(-1)[at] = np.exp(np.clip(self.emissions(words), -30, 30))
                live.reshape(-1)[at] = True
        (a, b), (c, d) = np.exp(self.move)

        def ahead(x, y, t):  # one word further
            x2, y2 = x * a + y * c, (x * b + y * d) * odds[:, t]
            s = x2 + y2
            return np.where(live[:, t], x2 / s, x), np.where(live[:, t], y2 / s, y), np.where(live[:, t], s, 1.0)

        def back(x, y, t):
            w = y * odds[:, t]
            x2, y2 = a * x + b * w, c * x + d * w
            s = x2 + y2
            return np.where(live[:, t], x2 / s, x), np.where(live[:, t], y2 / s, y)

        # What a block does to each of the two unit messages, then the messages at block starts, document by document.
        into = []
        for x, y in ((1.0, 0.0), (0.0, 1.0)):
            x, y, size = np.full(total, x), np.full(total, y), np.zeros(total)
            for t in range(BLOCK):
                x, y, s = ahead(x, y, t)
                size += np.log(s)
            into.append((x, y, size))
        top = np.maximum(into[0][2], into[1][2])
        kernel = np.array([[into[k][0] * np.exp(into[k][2] - top), into[k][1] * np.exp(into[k][2] - top)] for k in (0, 1)])
        start, end = np.full((2, total), 0.5), np.full((2, total), 0.5)
        order = np.argsort(-blocks)
        many = np.sort(blocks)[::-1]
        fx = np.full((2, len(texts)), 0.5)
        for k in range(int(blocks.max())):
            who = order[: np.searchsorted(-many, -k, side="left")]
            at = first[who] + k
            start[:, at] = fx[:, who]
            new = np.einsum("in,ijn->jn", fx[:, who], kernel[:, :, at])
            fx[:, who] = new / new.sum(axis=0)
        bx = np.full((2, len(texts)), 0.5)
        for k in range(int(blocks.max())):
            who = order[: np.searchsorted(-many, -k, side="left")]
            at = first[who] + blocks[who] - 1 - k
            end[:, at] = bx[:, who]
            new = np.einsum("jn,ijn->in", bx[:, who], kernel[:, :, at])
            bx[:, who] = new / new.sum(axis=0)
        x, y = start
        forward = np.empty((2, BLOCK, total))
        for t in range(BLOCK):
            x, y, _ = ahead(x, y, t)
            forward[0, t], forward[1, t] = x, y
        x, y = end
        out = np.empty((total, BLOCK))
        for t in range(BLOCK - 1, -1, -1):
            one = forward[1, t] * y
            out[:, t] = one / (one + forward[0, t] * x)
            x, y = back(x, y, t)
        flat = out.reshape(-1)
        return [flat[f * BLOCK : f * BLOCK + n] for f, n in zip(first, counts)]

    def evidence(self, marginals: list[np.ndarray]) -> np.ndarray:
        """Per document: 1, log odds of the highest marginal, log of the expected toxic words, log of the length."""
        top = np.array([m.max() if len(m) else 0.0 for m in marginals]).clip(1e-6, 1 - 1e-6)
        total = np.array([m.sum() for m in marginals])
        length = np.array([len(m) for m in marginals])
        return np.stack([np.ones(len(top)), np.log(top / (1 - top)), np.log(total + 1e-4), np.log(length + 1.0)], axis=1)

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(marginals), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.evidence(marginals) @ self.scale, -30, 30)))


def windows(words: list[str], toxic: set[str], label: int, random: np.random.Generator) -> list[tuple[list[str], np.ndarray]]:
    """Stretches of a document for the fit: around its toxic words, and one anywhere."""
    tags = np.array([label == 1 and w in toxic for w in words], dtype=np.int64)
    starts = [int(random.integers(0, max(1, len(words) - WINDOW)))] if label == 0 or tags.any() else []
    last = -WINDOW
    for i in np.flatnonzero(tags):
        if i >= last + WINDOW // 2 and len(starts) < STRETCHES:
            starts.append(max(0, int(i) - WINDOW // 2))
            last = i
    return [(words[s : s + WINDOW], tags[s : s + WINDOW]) for s in starts]


def fit(texts: list[str], labels: list[int], base_rate: float, steps: int = 60, seed: int = 1) -> Field:
    """The field for a sample of texts; base_rate is the share of toxic among all labels."""
    labels = np.array(labels, dtype=np.int64)
    empty = Field(np.zeros(1 << HASH_BITS), np.zeros((2, 2)), np.zeros(4), constant=base_rate)
    if not (labels == 1).any() or not (labels == 0).any():
        return empty
    same: dict[str, str] = {}
    words = [[same.setdefault(w, w) for w in lower_words(t)] for t in texts]
    toxic = toxic_words(words, labels)
    random = np.random.default_rng(seed)
    calibrate = np.array([zlib.crc32(t.encode()) % 3 == 0 for t in texts])
    runs = [w for i in range(len(words)) if not calibrate[i] and words[i] for w in windows(words[i], toxic, labels[i], random)]
    while len(runs) * WINDOW > SAMPLE_WORDS:
        runs = runs[::2]
    model = Field(np.zeros(1 << HASH_BITS), np.zeros((2, 2)), np.zeros(4))
    if runs:
        feats, tags, mask = np.zeros((len(runs), WINDOW, 3), np.int64), np.zeros((len(runs), WINDOW), np.int64), np.zeros((len(runs), WINDOW), bool)
        for r, (some, tag) in enumerate(runs):
            feats[r, : len(some)] = [features(w) for w in some]
            tags[r, : len(some)], mask[r, : len(some)] = tag, True
        model.move, model.weights = fit_chain(feats, tags, mask, steps)
    found = np.concatenate([model.evidence(m) for _, m in in_blocks(model, words)])
    own = calibrate if 20 < calibrate.sum() and len(set(labels[calibrate])) == 2 else np.ones(len(words), bool)
    x, y = found[own], labels[own]
    weight = np.where(y == 1, base_rate / max((y == 1).mean(), 1e-9), (1 - base_rate) / max((y == 0).mean(), 1e-9))
    for _ in range(30):  # Newton steps of a lightly penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ model.scale, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.05 * model.scale
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        model.scale = model.scale + np.linalg.solve(bend, slope)
    model.known = {}
    return model


def fit_chain(feats: np.ndarray, tags: np.ndarray, mask: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions and feature weights of highest penalised likelihood, by Adagrad over all windows."""
    used, index = np.unique(feats[mask], return_inverse=True)
    places = np.zeros(feats.shape, np.int64)
    places[mask] = index.reshape(-1, 3)
    w, move = np.zeros(len(used)), np.zeros((2, 2))
    g_w, g_move = np.full(len(used), 1e-3), np.full((2, 2), 1e-3)
    pairs = mask[:, 1:]
    counts = np.array([[(pairs & (tags[:, :-1] == i) & (tags[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    for _ in range(steps):
        emit = w[places].sum(axis=2)
        forward, backward, _ = chain(emit, mask, move)
        both = forward * backward
        p = (both[:, :, 1] / both.sum(axis=2)).T
        slope = np.bincount(places[mask].reshape(-1), np.repeat((tags - p)[mask], 3), len(used)) - 0.05 * w
        odds, trans = np.exp(np.clip(emit, -30, 30)), np.exp(move)
        expected = np.zeros((2, 2))
        later = backward[1:] * np.stack([np.ones_like(odds.T[1:]), odds.T[1:]], axis=2)
        joint = forward[:-1, :, :, None] * trans * later[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        expected = (joint * pairs.T[:, :, None, None]).sum(axis=(0, 1))
        slope_move = counts - expected - 0.05 * move
        g_w += slope**2
        g_move += slope_move**2
        w += 0.5 * slope / np.sqrt(g_w)
        move = move + 0.3 * slope_move / np.sqrt(g_move)
    weights = np.zeros(1 << HASH_BITS)
    weights[used] = w
    return move, weights


def learn(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Field:
    """Fit a field to the bounded sample of labelled documents."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = None
    for label, most in enumerate(per_class):
        one = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = one if picked is None else picked.unionByName(one)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter(F.length("text") <= SAMPLE_CHARS).select("text", "toxic", "doc_id")
    rows = sorted(found.orderBy(F.xxhash64("text"), "doc_id", "toxic").limit(2 * sum(per_class)).collect(), key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], base)


def in_blocks(model: Field, texts: Iterable[list[str]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Marginals of texts as words, some hundred thousand words at a time: (position of the first, marginals)."""
    held, size, start = [], 0, 0
    for words in texts:
        held.append(words)
        size += len(words)
        if size > WORDS_AT_ONCE:
            yield start, model.marginals(held)
            held, size, start = [], 0, start + len(held)
    if held:
        yield start, model.marginals(held)


def score_batches(model: Field, texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Marginals of the texts, by in_blocks."""
    return in_blocks(model, (lower_words(t or "") for t in texts))


def offences(text: str, marginals: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """(start, end, highest marginal) of the stretches of words with a marginal of at least this."""
    hit = marginals >= least
    if not hit.any():
        return []
    places = [m.span() for m in WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(places[a][0], places[b - 1][1], float(marginals[a:b].max())) for a, b in edges.reshape(-1, 2)]


SCORED = "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>"


def score(docs: DataFrame, model: Field, threshold: float = 0.5, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start, end, marginal of offending stretches, end exclusive) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores, spans = batch["text"].to_pylist(), [], []
            for first, found in score_batches(shared.value, texts):
                scores.extend(shared.value.scores(found))
                spans += [[dict(zip(("start", "end", "marginal"), x)) for x in offences(texts[first + k] or "", m, least)] for k, m in enumerate(found)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array(spans, spans_type)], ["doc_id", "score", "spans"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, SCORED)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def reject_toxic(docs: DataFrame, model: Field, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score below the threshold, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scores(m) for _, m in score_batches(shared.value, batch["text"].to_pylist())]
            yield batch.filter(pa.array(np.concatenate(found) < threshold) if found else pa.array([], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.withColumn("spans", said)


QUERIES = {"op4_toxicity": op4}
SQL: dict[str, str] = {}
