"""Scalar functions on names, digests, numbers and times, as columns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def content_path(digest: Column) -> Column:
    """Place of an object in a store: its first two digits are a folder."""
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substr(digest, F.lit(3)))


def digest_parts(said: Column) -> Column:
    """hex, algorithm and suffix of a digest's text form."""
    part = lambda i: F.regexp_extract(said, "^([0-9a-f]+)(?:-(rmd160|shake128))?([A-Z]?)$", i)
    return F.struct(part(1).alias("hex"), part(2).alias("algorithm"), part(3).alias("suffix"))


def url_base64(data: Column) -> Column:
    """Base64 with the characters that are safe in an address."""
    return F.translate(F.regexp_replace(F.base64(data), r"\s", ""), "+/", "-_")


def human_size(size: Column) -> Column:
    unit = lambda n, name: F.concat(F.format_string("%.3f", size / F.lit(float(n))), F.lit(f" {name}"))
    return F.when(size > 1 << 30, unit(1 << 30, "GiB")).when(size > 1 << 20, unit(1 << 20, "MiB")).when(size > 1 << 10, unit(1 << 10, "kiB")).otherwise(F.concat(size.cast("string"), F.lit(" Byte")))


def iso_time(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_iso(said: Column) -> Column:
    """Epoch seconds of a time of exactly 20 characters, else 0."""
    right = said.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.when(right, F.unix_timestamp(F.try_to_timestamp(said, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))).otherwise(0)


def expanded(link: Column, names: Column) -> Column:
    """A symbolic link with $(NAME) and $(NAME:-default) replaced from a map; what is not closed stays as it is."""
    pieces = F.split(link, r"\$\(", -1)

    def value(piece: Column) -> Column:
        inner, rest = F.regexp_extract(piece, r"^([^)]*)\)", 1), F.regexp_replace(piece, r"^[^)]*\)", "")
        found = F.try_element_at(names, F.substring_index(inner, ":-", 1))
        default = F.when(F.contains(inner, F.lit(":-")), F.regexp_replace(inner, "^.*?:-", "")).otherwise("")
        return F.when(F.contains(piece, F.lit(")")), F.concat(F.coalesce(found, default), rest)).otherwise(F.concat(F.lit("$("), piece))

    return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), value), ""))


def image_parts(name: Column) -> Column:
    """scheme, registry, repository, tag and digest of an image's name, with defaults."""
    part = lambda i: F.regexp_extract(name, r"^(?:(https?)://)?([^/]+)/([^:@]+)(?::([^@]+))?(?:@(.+))?$", i)
    tag = F.when((part(4) == "") & (part(5) == ""), "latest").otherwise(part(4))
    return F.struct(F.when(part(1) == "", "https").otherwise(part(1)).alias("scheme"), part(2).alias("registry"), part(3).alias("repository"), tag.alias("tag"), part(5).alias("digest"))


@F.pandas_udf(BinaryType())
def compressed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for data in parts:
        yield data.map(lambda x: None if x is None else zlib.compress(x))


@F.pandas_udf(BinaryType())
def decompressed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for data in parts:
        yield data.map(lambda x: None if x is None else zlib.decompress(x))
