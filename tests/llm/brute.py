"""Plain versions of the operators, for comparison on small tables, and the odd rows that every operator must handle."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside, as columns of an input.
CLASHES = "key fp own digest norm ka kb shard copy place its_id its_place kept_sha kept_id kept_key component_id keep_id group_size size at block taken target score rank list bits p bucket count h marks copied base added".split()
LONG = " ".join(f"w{i % 977}x{i * i % 1009}" for i in range(20_000))
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n\x0b\x0c\r ", "en", None),
    (4, "one", None, "a"),
    (5, "one", "de", "b"),
    (6, LONG, "en", "b"),
    (7, LONG, "fr", "b"),
    (8, "x  y\tz", "en", "c"),
    (8, "x  y\tz", "en", "c"),
    (9, "x y z", "en", "c"),
    (None, "x y z", "en", "c"),
    (None, None, None, None),
    (10, "Zoë 你好 \U0001f600    é \x1c\x1d\x85 end", "xx", "d"),
    (11, "L" * 300_000, "en", "d"),
    (12, "line\n" * 500, "en", "e"),
]


def documents(spark: SparkSession, rows: list[tuple] = ODD, clashes: bool = True) -> DataFrame:
    """Rows (doc_id, text, lang, source) with n_chars, and with columns of clashing names."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES}) if clashes else df


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def least(ids: list) -> int | None:
    return min((i for i in ids if i is not None), default=None)


def exact(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept, text_sha256) of rows (doc_id, text)."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), n in zip(rows, norm):
        groups[n].append(i)
    return [(i, least(groups[n]), len(groups[n]), i == least(groups[n]), sha(n)) for (i, _), n in zip(rows, norm)]


def simhash(text: str | None) -> int:
    w = [x for x in words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def components(prints: list[int], bits: int = 3) -> dict[int, int]:
    """Each distinct fingerprint to one of its component."""
    distinct = sorted(set(prints))
    root = {f: f for f in distinct}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def near(rows: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component_id) of rows (doc_id, text)."""
    prints = [simhash(t) for _, t in rows]
    of = components(prints)
    ids = defaultdict(list)
    for (i, _), f in zip(rows, prints):
        ids[of[f]].append(i)
    return [(i, f"{f:016x}", least(ids[of[f]])) for (i, _), f in zip(rows, prints)]


def substrings(rows: list[tuple], window: int = 35) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text)."""
    texts = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.no_padding()
    found.no_truncation()
    return found


def encoded(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, text), by the tokenizers library."""
    t = tokenizer()
    out = []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def personal(rows: list[tuple]) -> list[tuple]:
    """(doc_id, counts by kind, base spans) of rows (doc_id, text)."""
    out = []
    for doc_id, text in rows:
        held = {k: "" if k == "email" and "@" not in (text or "") else text or "" for k in KINDS}  # else very slow on long texts
        spans = {k: [m.span() for m in re.finditer(p, held[k]) if ok(m[0])] for k, (p, ok) in KINDS.items()}
        said = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])
        out.append((doc_id, *[len(spans[k]) for k in KINDS], said))
    return out


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
