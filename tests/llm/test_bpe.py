from __future__ import annotations

import random
import sys
import tracemalloc

from brute import documents, encoded, ordered, tokenizer

from treelake.llm import bpe
from treelake.llm.queries import QUERIES


def model(**options) -> bpe.ByteBpe:
    with open(bpe.default_vocabulary(), "rb") as file:
        return bpe.ByteBpe(file.read(), **options)


def ids(packed: bytes) -> list[int]:
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def test_query_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op2_bpe"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert ordered(found) == ordered(encoded([tuple(r) for r in docs]))


def test_odd_rows(spark):
    df = documents(spark)
    found = bpe.round_trip_digests(df, bpe.default_vocabulary()).collect()
    assert ordered(found) == ordered(encoded([(r["doc_id"], r["text"]) for r in df.collect()]))
    assert bpe.round_trip_digests(documents(spark, []), bpe.default_vocabulary()).count() == 0


def test_random_texts_equal_the_library():
    rng, library, own = random.Random(5), tokenizer(), model()
    alphabet = list("aabcdeeinrst  \n\t.,'0123456789-") + ["\x1c", "\x1f", "\x85", " ", " ", "　", "᠎", "​", "﻿", "é", "́", "你", "\U0001f600", "ก", "Ⅴ", "½", "'s", "'ll", " the", "<|endoftext|>", "\x00", "", "", "\x1e"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a" * 1000, "ab" * 700, " " * 500, "\n" * 300 + "x", "th" * 400 + " the " * 300]
    packed = list(own.encode(texts))
    wanted = library.encode_batch(texts, add_special_tokens=False)
    assert [ids(p) for p in packed] == [w.ids for w in wanted]
    assert [own.decode(p) for p in packed] == [library.decode(w.ids, skip_special_tokens=False) for w in wanted]


def test_small_caches_slices_and_spans_change_nothing():
    texts = ["some words here", "other words there", "some  other text", "", "a b " * 50, "x" * 500] * 3
    wanted = list(model().encode(texts))
    assert list(model(remembered=1).encode(texts)) == list(model(slice_size=1).encode(texts)) == list(model(span=7).encode(texts)) == wanted


def test_encode_then_decode(spark):
    df = documents(spark)
    path = bpe.default_vocabulary()
    found = bpe.decode(bpe.encode(df, path), path).collect()
    assert ordered(found) == ordered((r["doc_id"], r["text"] or "") for r in df.collect())


def test_memory_of_a_worker_is_bounded():
    rng, own = random.Random(3), model()
    texts = (" ".join("".join(rng.choices("abcdeinorst", k=6)) for _ in range(500)) for _ in range(1000))
    tracemalloc.start()
    try:
        for _ in own.encode(texts):
            pass
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()


def test_white_space_of_all_kinds_before_spaces_equals_the_library():
    library, own = tokenizer(), model(slice_size=50)
    spaces = [c for c in map(chr, range(sys.maxunicode)) if c.isspace()]
    texts = [f"{a}{b} {c} y{a}  {b}z {a}" for a in "aé你\U0001f600à\x80\x1b" for b in [*spaces, "\u200b", "\u180e", "à", "\u5000"] for c in ("x", "<|endoftext|> ", b)]
    assert [ids(p) for p in own.encode(texts)] == [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]
    long = [" ".join(texts), "".join(texts)] * 2
    assert [ids(p) for p in model(slice_size=50, span=20).encode(long)] == [w.ids for w in library.encode_batch(long, add_special_tokens=False)]


def test_many_words_are_encoded_once():
    own, words = model(), []
    encode = own.encode_words
    own.encode_words = lambda new: words.append(len(new)) or encode(new)
    made = [f" {''.join(chr(97 + i // 26**k % 26) for k in range(4))}" for i in range(400_000)]
    texts = ["".join(made[i : i + 1000]) for i in range(0, len(made), 1000)] * 2
    first = list(own.encode(texts))
    assert first[:400] == first[400:]
    assert sum(words) == len(made)
    words.clear()
    assert list(own.encode(texts)) == first
    assert sum(words) == 0
