"""Document bytes: reading files, telling encodings, decoding. All as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as x


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """doc_id (the path), content, name (its ni: name), media type by suffix, and text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    media = F.when(suffix == "xml", "application/xml").when(suffix == "json", "application/json").when(suffix == "ttl", "text/turtle").when(suffix == "nt", "application/n-triples")
    return files.select(F.col("path").alias("doc_id"), "content", x.ni_name(F.col("content")).alias("name"), media.alias("media_type"), decoded(F.col("content")).alias("text"))


def encoding(content: Column) -> Column:
    """By byte order mark, else by the zero bytes of UTF-16 markup, else by the label of an XML declaration, else UTF-8."""
    start = F.hex(F.substring(content, 1, 4))
    label = F.upper(F.regexp_extract(F.decode(F.substring(content, 1, 200), "ISO-8859-1"), "^<\\?xml[^>]*encoding=[\"\']([A-Za-z0-9._-]+)", 1))
    return (
        F.when(F.startswith(start, F.lit("EFBBBF")), "UTF-8")
        .when(F.startswith(start, F.lit("FFFE")), "UTF-16LE")
        .when(F.startswith(start, F.lit("FEFF")), "UTF-16BE")
        .when(start == "3C003F00", "UTF-16LE")
        .when(start == "003C003F", "UTF-16BE")
        .when(label.isin("ISO-8859-1", "LATIN1"), "ISO-8859-1")
        .when(label == "US-ASCII", "US-ASCII")
        .when((label == "") | (label == "UTF-8"), "UTF-8")
    )


def decoded(content: Column) -> Column:
    """Text of XML bytes without a byte order mark; NULL for an unknown label or malformed UTF-8."""
    e = encoding(content)
    utf16 = lambda name: F.decode(content, name)
    text = (
        F.when(e == "UTF-8", F.try_validate_utf8(content.cast("string")))
        .when(e == "UTF-16LE", utf16("UTF-16LE"))
        .when(e == "UTF-16BE", utf16("UTF-16BE"))
        .when(e == "ISO-8859-1", F.decode(content, "ISO-8859-1"))
        .when(e == "US-ASCII", F.decode(content, "ISO-8859-1"))
    )
    return F.regexp_replace(text, "^\\uFEFF", "")


def decoded_json(content: Column) -> Column:
    """Text of JSON bytes: UTF-8 only, and no byte order mark."""
    return F.when(~F.startswith(F.hex(F.substring(content, 1, 3)), F.lit("EFBBBF")), F.try_validate_utf8(content.cast("string")))
