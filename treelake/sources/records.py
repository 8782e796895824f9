"""Small text formats as columns, and lines that sinks write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finished_lines(text: Column) -> Column:
    """Lines that end in a newline, up to a line of two hyphens."""
    lines = F.split(text, "\n")
    stop = F.array_position(lines, "--")
    return F.slice(lines, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(lines) - 1).cast("int"))


def merged_map(entries: Column, joined: str | None = None) -> Column:
    """Map of entries (key, value): of repeated keys the last value counts, but those of the key joined go together, by bars."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    values = lambda k: F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"])
    one = lambda k: F.when(k == (joined or ""), F.array_join(values(k), "|")).otherwise(F.element_at(values(k), -1)) if joined else F.element_at(values(k), -1)
    return F.map_from_arrays(keys, F.transform(keys, one))


def letter_record(text: Column) -> Column:
    """Map of the first letter of each line to its rest; reading stops at a line of two hyphens. Lines of Z are joined."""
    lines = F.filter(finished_lines(text), lambda x: x != "")
    return merged_map(F.transform(lines, lambda x: F.struct(F.left(x, F.lit(1)).alias("key"), F.substr(x, F.lit(2)).alias("value"))), "Z")


def key_values(text: Column) -> Column:
    """Map of key=value lines; reading stops at a line of two hyphens."""
    lines = F.filter(finished_lines(text), lambda x: F.contains(x, F.lit("=")))
    return merged_map(F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value"))))


def id_rules(text: Column) -> Column:
    """valid, default and rules (map of id to id) of an id mapping file: lines of two numbers, a star for the default.

    Empty lines and comments are passed over; the last rule of an id counts; one wrong line makes the file invalid.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    parts = F.transform(lines, lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    right = lambda p: (F.size(p) == 2) & F.get(p, F.lit(1)).rlike("^[0-9]+$") & F.get(p, F.lit(0)).rlike("^(?:[*]|[0-9]+)$")
    valid = F.forall(parts, right)
    entries = F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value")))
    said = merged_map(F.when(valid, entries).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    rules = F.transform_keys(F.transform_values(F.map_filter(said, lambda k, _: k != "*"), lambda _, v: v.cast("long")), lambda k, _: k.cast("long"))
    return F.struct(valid.alias("valid"), F.try_element_at(said, F.lit("*")).cast("long").alias("default"), rules.alias("rules"))


def graft(text: Column) -> Column:
    """size, checksum, n_chunks and valid of a graft file: size and checksum are there, the chunk lists equally long."""
    said = key_values(text)
    at = lambda k: F.try_element_at(said, F.lit(k))
    n = lambda k: F.when(F.coalesce(at(k), F.lit("")) == "", 0).otherwise(F.size(F.split(at(k), ",")))
    valid = at("size").isNotNull() & at("checksum").isNotNull() & (n("chunk_offsets") == n("chunk_checksums"))
    return F.struct(at("size").cast("long").alias("size"), at("checksum").alias("checksum"), n("chunk_offsets").alias("n_chunks"), valid.alias("valid"))


def rule(line: Column) -> Column:
    """negated and pattern of a rule's line; null for comments and empty lines."""
    clean = F.trim(line)
    found = F.struct(F.startswith(clean, F.lit("!")).alias("negated"), F.trim(F.regexp_replace(clean, "^!", "")).alias("pattern"))
    return F.when((clean != "") & ~F.startswith(clean, F.lit("#")), found)


def influx_line(name: str, tags: dict[str, Column], fields: dict[str, Column], time: Column) -> Column:
    """A line of the line protocol."""
    said = lambda pairs: [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in pairs.items()]
    return F.concat_ws(" ", F.concat_ws(",", F.lit(name), *said(tags)), F.concat_ws(",", *said(fields)), time.cast("string"))


def csv_line(*values: Column) -> Column:
    """A quoted line."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(v.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for v in values])


def nested_json(counters: DataFrame) -> DataFrame:
    """namespace, json of counters (name, value): names before their dot are the namespace."""
    rows = counters.select(F.substring_index("name", ".", 1).alias("namespace"), F.regexp_replace("name", r"^[^.]*\.", "").alias("key"), "value")
    return rows.groupBy("namespace").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("json"))


def new_objects(objects: DataFrame, stored: DataFrame, key: str = "hash") -> DataFrame:
    """Objects to write: one of each digest that is not stored yet."""
    return objects.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def change_kind(entry: DataFrame) -> DataFrame:
    """path, kind of a layer's entries: a name that begins with .wh. removes, .wh..wh..opq makes its directory opaque."""
    name, parent = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/[^/]*$", "")
    opaque, white = name == ".wh..wh..opq", F.startswith(name, F.lit(".wh."))
    path = F.when(opaque, parent).when(white, F.concat(parent, F.lit("/"), F.regexp_replace(name, r"^\.wh\.", ""))).otherwise(F.col("path"))
    return entry.select(path.alias("path"), F.when(opaque, "opaque").when(white, "remove").otherwise("add").alias("kind"))
