"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks. High-recall generators propose more spans, which
may overlap: telephone numbers without a country code (local_phone), account numbers (iban), social security numbers
(ssn), and keys, tokens and passwords (secret). Boosted trees score format and context of every candidate. They learn from
weak labels: base cards and phones, phones without their country code, values that a cue word assigns and strings of published key
formats are personal; numbers that fail the checks or are short, dates and long plain words are not. Each is learned with
and without the text before it. Part of the sample is set aside to calibrate the threshold. Of candidates above it those
that overlap a base span go, and of those that chain by overlaps the best stays.

The fit sees every candidate of every text: features are rounded up to fixed steps (STEPS), equal rounded candidates are
counted, and the trees learn from these counts as weights, both classes with the same total. The features are told to
the trees as marks of passed steps, so that no split is taken from a sample of values. Selection reads every text.

Defined results: a null text counts as empty and has no spans; positions are code points, the end is exclusive; without
candidates of both classes nothing is added to the base spans; of candidates with one probability the first stays, then
that of the smaller kind; repeated rows and equal texts get equal spans; very long texts are read whole, in time linear
in their length but for sorting their spans; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelake.llm.common import rows_about, stored, table

#: Step and number of steps of each feature, as the fit sees it; quotients by a step are exact in double precision.
SHARE, MARK = (0.125, 8), (1.0, 1)
STEPS = ((4.0, 16), (1.0, 20), SHARE, SHARE, (1.0, 8), (4.0, 10), (2.0, 10), *[MARK] * 6, SHARE, *[MARK] * 6)
#: Distinct rounded candidates of one task of the fit.
FIT_ROWS = 100_000
#: Share of the calibration negatives that may pass the threshold.
FALSE_RATE = 0.001
BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "iban", "ssn", "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+={0,2}+(?![A-Za-z0-9])",
    "number": r"[0-9]++(?:[.,:/-][0-9]++)*+",
    "word": r"(?<![A-Za-z0-9+/_-])[A-Za-z]{12,}+(?![A-Za-z0-9+/_-])",
}
#: Published formats of access keys, and what assigns a secret to a name.
KEY = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}$|^xox[abprs]-|^sk-[A-Za-z0-9_-]{16,}$"
ASSIGNED = r"(?i)(?:pass|pwd|token|secret|key|credential)[a-z_]*[\"']?\s*[=:]\s*[\"']?$"
#: Words whose presence just before a candidate is a feature.
CUES = ("token|secret|key|passw", "tel|phone|call|fax|mobil", "iban|account|konto|compte|cuenta", "ssn|social|card|visa", "version|license|page|chapter")
SPAN = "array<struct<kind:string,start:int,end:int,text:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """Running results of join over an array of int not below 0, in chunks so that long arrays stay cheap."""
    zero = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    sums = lambda a: F.aggregate(a, zero, lambda acc, x: F.concat(acc, F.array(join(last(acc), x))))

    def chunks(v: Column) -> Column:
        count = F.floor((F.size(v) - 1) / chunk).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda c: sums(F.slice(v, c * chunk + 1, F.lit(chunk))))

    def joined(inside: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(0)), sums(F.transform(inside, last))), F.lit(1), F.size(inside))
        return F.flatten(F.zip_with(inside, before, lambda a, o: F.transform(a, lambda x: join(x, o))))

    return let(values, lambda v: let(chunks(v), joined))


def spans_of(text: Column, kind: str) -> Column:
    """All leftmost non-overlapping matches of a kind's pattern, with their places and the text between matches around."""
    matched = F.struct(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("found"), F.split(text, PATTERNS[kind], -1).alias("gaps"))

    def spans(m: Column) -> Column:
        found, gaps = m["found"], m["gaps"]
        around = F.arrays_zip(found.alias("text"), F.slice(gaps, F.lit(1), F.size(found)).alias("before"), F.slice(gaps, F.lit(2), F.size(found)).alias("after"))
        widths = F.transform(around, lambda a: F.length(a["text"]) + F.length(a["before"]))

        def span(a: Column, end: Column) -> Column:
            start = end - F.length(a["text"])
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), a["text"].alias("text"), F.right(a["before"], F.lit(24)).alias("before"), F.left(a["after"], F.lit(4)).alias("after"))

        return F.when(F.size(found) > 0, F.zip_with(around, running(widths, lambda a, b: a + b), span)).otherwise(F.array().cast(SPAN))

    return let(matched, spans)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.split(F.reverse(number), "")

    def value(i: Column) -> Column:
        x = F.coalesce(F.try_element_at(values, i).cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def passes(kind: str, text: Column) -> Column:
    """Whether a match of a base kind's pattern is kept."""
    number = digits(text)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?"
        return text.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(8, 15)
    return F.lit(True)


def iban_check(text: Column) -> Column:
    """Whether letters and digits pass the check of account numbers: moved by four, letters as two digits, modulo 97."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


#: What a text must hold to have matches of a kind at all.
NEEDS = {"email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+"), "word": lambda t: F.lit(True)}


def found(text: Column, kind: str, keep: Callable[[Column], Column]) -> Column:
    needed = NEEDS.get(kind, lambda t: t.rlike("[0-9]"))(text)
    return F.when(needed, F.filter(spans_of(text, kind), keep)).otherwise(F.array().cast(SPAN))


def features(c: Column) -> Column:
    """Format and context of a candidate as an array of double."""
    text, number = c["text"], digits(c["text"])
    size, n = F.length(text).cast("double"), F.length(number).cast("double")
    as_double = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    before = F.lower(c["before"])
    values = [
        size,
        n,
        n / size,
        F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / size,
        F.length(F.regexp_replace(text, r"[A-Za-z0-9]", "")).cast("double"),
        F.size(F.array_distinct(F.split(text, ""))).cast("double"),
        F.size(F.split(text, "[A-Za-z][0-9]|[0-9][A-Za-z]", -1)).cast("double"),
        as_double(text.contains("@")),
        as_double(text.rlike(r"^\+|^\(")),
        as_double(F.when(n.between(12, 19), luhn(number)).otherwise(False)),
        as_double(passes("ip", text)),
        as_double(F.when(text.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{10,32}$"), iban_check(text)).otherwise(False)),
        as_double(text.rlike(r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}$|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}$")),
        F.length(F.regexp_replace(text, "[^A-Z]", "")) / size,
        as_double(before.rlike(r"[=:]\s*[\"']?$")),
        *[as_double(before.rlike(cue)) for cue in CUES],
    ]
    return F.array(*values)


def valid(kind: str) -> Callable[[Column], Column]:
    return lambda c: passes(kind, c["text"])


def invalid(kind: str) -> Callable[[Column], Column]:
    return lambda c: ~passes(kind, c["text"])


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> list[Column]:
    return [found(text, kind, valid(kind)) for kind in BASE]


def extra_candidates(text: Column) -> Column:
    """Proposals for added kinds."""
    mixed = lambda c: c["text"].rlike("[0-9]") & c["text"].rlike("[A-Za-z]")
    return F.concat(*[found(text, kind, mixed if kind == "secret" else lambda c: F.length(c["text"]) > 0) for kind in ADDED])


def without_code(c: Column) -> Column:
    """A phone without its country code."""
    return c.withField("text", F.regexp_replace(c["text"], r"^\+[0-9]{1,3}[\x20.-]?", ""))


def weak_labels(text: Column) -> tuple[Column, Column]:
    """Candidates of a text that count as personal, and those that do not."""
    secret = found(text, "secret", lambda c: c["text"].rlike("[0-9]") & c["text"].rlike("[A-Za-z]") & (c["before"].rlike(ASSIGNED) | c["text"].rlike(KEY)))
    phones = found(text, "phone", valid("phone"))
    good = F.concat(found(text, "card", valid("card")), phones, F.transform(phones, without_code), secret)
    small = found(text, "number", lambda c: F.length(digits(c["text"])) < 9)
    word = F.regexp_extract(text, PATTERNS["word"], 0)
    blank = F.lit("")
    plain = F.when(word != "", F.array(F.struct(F.lit("word").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), word.alias("text"), blank.alias("before"), blank.alias("after")))).otherwise(F.array().cast(SPAN))
    return good, F.concat(found(text, "ip", invalid("ip")), found(text, "card", invalid("card")), small, plain)


def counted(docs: DataFrame) -> DataFrame:
    """label, held (set aside for calibration), levels (steps that each feature passes), n of the weakly labelled candidates of all texts."""
    text = F.coalesce("text", F.lit(""))
    good, bad = weak_labels(F.col("text"))
    label = lambda spans, y: F.transform(spans, lambda c: F.struct(F.lit(y).alias("label"), c.alias("c")))
    rows = docs.select(text.alias("text")).select(F.explode(F.concat(label(good, 1.0), label(bad, 0.0))).alias("x")).select("x.label", "x.c")
    rows = rows.withColumn("held", F.pmod(F.xxhash64(F.xxhash64("c.kind", "c.text", "c.before")), F.lit(4)) == 0)
    blind = F.col("c").withField("before", F.lit(""))
    rows = rows.select("label", "held", F.explode(F.array(F.col("c"), blind)).alias("c")).select("label", "held", features(F.col("c")).alias("f"))
    levels = F.array(*[F.least(F.ceil(F.col("f")[i] / step), F.lit(top)).cast("int") for i, (step, top) in enumerate(STEPS)])
    return rows.select("label", "held", levels.alias("levels")).groupBy("label", "held", "levels").agg(F.count("*").alias("n"))


def fit(docs: DataFrame) -> tuple[list[tuple[float, dict | float]], float] | None:
    """Boosted trees (weight, tree) and the calibrated threshold, from all weakly labelled candidates."""
    counts = stored(counted(docs), "pii-counts")
    learned = counts.filter("not held")
    totals = {r["label"]: r["n"] for r in learned.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(totals) < 2:
        return None
    weight = F.col("n") * F.when(F.col("label") == 1, sum(totals.values()) / 2 / totals[1.0]).otherwise(sum(totals.values()) / 2 / totals[0.0])
    marks = [(i, k) for i, (_, top) in enumerate(STEPS) for k in range(top)]
    passed = array_to_vector(F.array(*[(F.col("levels")[i] > k).cast("double") for i, k in marks]))
    nominal = [{"idx": at, "name": f"f{i}_{k}", "vals": ["0", "1"]} for at, (i, k) in enumerate(marks)]
    train = learned.select("label", weight.alias("weight"), passed.alias("features", metadata={"ml_attr": {"attrs": {"nominal": nominal}, "num_attrs": len(marks)}}))
    train = train.coalesce(rows_about(learned, FIT_ROWS))
    model = GBTClassifier(maxIter=12, maxDepth=4, seed=1, stepSize=0.3, maxBins=16, weightCol="weight").fit(train)
    trees = [(w, parse_tree(t.toDebugString, marks)) for w, t in zip(model.treeWeights, model.trees)]
    rounded = F.array(*[F.col("levels")[i] * F.lit(step) for i, (step, _) in enumerate(STEPS)])
    scores = counts.filter("held and label = 0").select(probability(trees, rounded).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    limit = scores.agg(F.percentile("p", 1 - FALSE_RATE, F.col("n"))).first()[0]
    return trees, max(0.5, limit or 0.0)


def parse_tree(said: str, marks: list[tuple[int, int]]) -> dict | float:
    """A fitted tree over marks (feature, step) from its description: a number, or a feature, a threshold and two trees."""
    lines = [x.strip() for x in said.splitlines()[1:] if x.strip()]

    def node(at: int) -> tuple[dict | float, int]:
        if m := re.match(r"Predict: (\S+)", lines[at]):
            return float(m[1]), at + 1
        m = re.match(r"If \(feature (\d+) in \{([01])\.0\}\)", lines[at])
        first, at = node(at + 1)
        second, at = node(at + 1)
        feature, step = marks[int(m[1])]
        low, high = (first, second) if m[2] == "0" else (second, first)
        return {"feature": feature, "threshold": step * STEPS[feature][0], "low": low, "high": high}, at

    return node(0)[0]


def probability(trees: list[tuple[float, dict | float]], f: Column) -> Column:
    """Probability that boosted trees give an array of features."""

    def value(tree: dict | float) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        return F.when(f[tree["feature"]] <= tree["threshold"], value(tree["low"])).otherwise(value(tree["high"]))

    total = F.lit(0.0)
    for weight, tree in trees:
        total = total + weight * value(tree)
    return 1 / (1 + F.exp(-2 * total))


def find(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, columns, base (array of base spans by kind, then start), added (array of added spans, by start) of every row."""
    fitted = fit(docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("base", F.concat(*base_spans(F.col("text"))))
    if fitted is None:
        return rows.select("doc_id", *columns, "base", F.array().cast(SPAN).alias("added"))
    trees, threshold = fitted
    none = F.array().cast(SPAN)
    scored = F.transform(extra_candidates(F.col("text")), lambda c: F.struct(c.alias("c"), features(c).alias("f")))
    scored = F.transform(scored, lambda x: F.struct(x["c"].alias("c"), probability(trees, x["f"]).alias("p")))
    scored = F.filter(scored, lambda x: x["p"] > threshold)
    rows = rows.withColumn("proposed", F.when(F.col("text").rlike("[0-9]"), scored).otherwise(F.array().cast(f"array<struct<c:{SPAN[6:-1]},p:double>>")))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *columns, "base", "proposed"), "pii-spans")
    added = chosen(rows.filter(F.size("proposed") > 0))
    return rows.join(added, "row", "left").select("doc_id", *columns, "base", F.coalesce("added", none).alias("added"))


def chosen(rows: DataFrame) -> DataFrame:
    """row, added: the proposals that overlap no base span, the best of each chain of overlapping ones."""
    spans = F.concat(F.transform("base", lambda c: F.struct(c.alias("c"), F.lit(None).cast("double").alias("p"))), F.col("proposed"))
    spans = rows.select("row", F.explode(spans).alias("x")).select("row", "x.c", "x.p", F.col("x.c.start").alias("start"), F.col("x.c.end").alias("end"), F.col("x.p").isNull().alias("is_base"))
    by_start = Window.partitionBy("row").orderBy("start", "end", "c.kind")
    upto, onward = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)
    reached = F.coalesce(F.max(F.when(F.col("is_base"), F.col("end"))).over(upto), F.lit(-1))
    ahead = F.min(F.when(F.col("is_base"), F.col("start"))).over(onward)
    free = spans.withColumns({"reached": reached, "ahead": ahead}).filter("not is_base and reached <= start and (ahead is null or ahead >= end)")
    free = free.withColumn("opens", (F.col("start") >= F.coalesce(F.max("end").over(upto), F.lit(-1))).cast("int"))
    free = free.withColumn("chain", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy("row", "chain").orderBy(F.desc("p"), "start", "c.kind"))
    best = free.withColumn("place", best).filter("place = 1").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "c"))).alias("found"))
    return best.select("row", F.transform("found", lambda x: x["c"]).alias("added"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with every base and added span replaced by its kind in brackets."""
    rows = find(docs, "text").withColumn("all", F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["end"], s["kind"]))))

    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    rows = find(docs, "text").withColumn("spans", spans)
    reached = F.concat(F.array(F.lit(0)), running(F.transform("spans", lambda s: s["end"]), F.greatest))

    def said(x: Column) -> Column:
        part = lambda start, end: F.array_join(F.slice(x["chars"], start + 1, F.greatest(end - start, F.lit(0))), "")
        pieces = F.zip_with("spans", F.slice(x["reached"], F.lit(1), F.size("spans")), lambda s, at: F.concat(part(at, s["start"]), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(x["reached"], -1), F.length("text")))

    redacted = let(F.struct(F.split("text", "").alias("chars"), reached.alias("reached")), said)
    return rows.select("doc_id", F.when(F.size("spans") > 0, redacted).otherwise(F.col("text")).alias("text"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    said = lambda spans: F.array_join(F.transform(spans, name), ",")
    counts = [F.size(F.filter("base", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return rows.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.concat("base", "added")).alias("spans"))


QUERIES = {"op6_pii": op6}
SQL: dict[str, str] = {}
