"""Conversion of a table of documents: one plan over all records of all documents.

An adapter is a plain object: how documents split into records, mappings from quads to solutions and their templates,
accounting, gaps and notations for findings, and a schema. Mappings are functions of the quads DataFrame, written with the
operators of this library; each runs once for the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as x
from loomgraph.operators import construct, findings, patterns, records, validation
from loomgraph.sources import nodes as nd
from loomgraph.sources import triples as tr
from loomgraph.tables import shared_dir, written


class DocumentError(ValueError):
    """A document that can't be read, in strict mode."""


class AdapterError(ValueError):
    """An adapter that contradicts itself."""


@dataclass(frozen=True)
class Adapter:
    syntax: str  # xml or json
    unit: str | None  # record element, or the member whose items are the records
    mappings: list[Callable[[DataFrame], tuple[DataFrame, list[tuple]]]] = field(default_factory=list)
    detect: Callable[[DataFrame], DataFrame] | None = None
    accounting: DataFrame | None = None
    gaps: DataFrame | None = None
    notations: DataFrame | None = None
    schema: dict | None = None
    declared: DataFrame | None = None

    def checked(self) -> Adapter:
        if self.syntax not in ("xml", "json"):
            raise AdapterError(f"no such syntax: {self.syntax}")
        if self.syntax == "xml" and not self.unit:
            raise AdapterError("an XML adapter names its record element")
        if self.accounting is not None:
            twice = self.accounting.groupBy("path").agg(F.count_distinct("verdict").alias("n")).filter("n > 1").first()
            if twice:
                raise AdapterError(f"two verdicts on {twice['path']}")
            half = self.accounting.filter("(lookup IS NULL) <> (miss_gap IS NULL)").first()
            if half:
                raise AdapterError(f"half a lookup at {half['path']}")
        return self


@dataclass
class Conversion:
    """graph: (doc_id, record, s, p, o); versions; findings: (doc_id, record, path, within, n, body, severity, value); errors: (doc_id, reason)."""

    graph: DataFrame
    versions: DataFrame
    findings: DataFrame
    errors: DataFrame
    names: DataFrame


def _nodes(docs: DataFrame, adapter: Adapter) -> DataFrame:
    return nd.xml_nodes(docs, adapter.unit) if adapter.syntax == "xml" else nd.json_nodes(docs, adapter.unit)


def accepts(docs: DataFrame, adapter: Adapter) -> DataFrame:
    """doc_id, accepted: the detect query over each document's skeleton."""
    skeleton = tr.skeleton(_nodes(docs, adapter))
    found = adapter.detect(skeleton).select("doc_id").distinct().withColumn("accepted", F.lit(True))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def convert(docs: DataFrame, adapter: Adapter, strict: bool = False) -> Conversion:
    """docs: doc_id and text. Parsing happens once; nodes are written to the shared folder and all plans read them."""
    adapter = adapter.checked()
    nodes = written(_nodes(docs, adapter), shared_dir(docs.sparkSession), "nodes")
    errors = nodes.filter("kind = 'error'").select("doc_id", F.col("value").alias("reason"))
    if strict and (first := errors.first()):
        raise DocumentError(f"document {first['doc_id']}: {first['reason']}")
    lifted = tr.xml_triples(nodes) if adapter.syntax == "xml" else tr.json_triples(nodes)
    quads = patterns.colocated(lifted)
    empty = quads.limit(0)
    mapped = [construct.construct(solutions, *template) for solutions, template in (mapping(quads) for mapping in adapter.mappings)]
    graph = reduce(DataFrame.union, mapped, empty).dropDuplicates(["rid", "s", "p", "o"])
    versions = records.kept(records.versions(graph))
    out = records.without_dropped(graph, versions.drop("kept"))

    census = tr.census(nodes)
    made = []
    blank = lambda df: df.select("doc_id", "record", "path", *(F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in (("within", "string"), ("n", "long"), ("body", "string"), ("severity", "string"), ("value", "string"))))
    if adapter.accounting is not None:
        made.append(blank(findings.unaccounted(census, adapter.accounting)))
        if adapter.gaps is not None:
            made.append(blank(findings.declared_gaps(census, adapter.accounting, adapter.gaps)))
            if adapter.notations is not None:
                held = nodes.filter("record >= 0 AND value IS NOT NULL").select("doc_id", "record", "path", "value", F.col("selector").alias("within"))
                misses = findings.lookup_misses(held, adapter.accounting, adapter.notations)
                made.append(blank(findings.with_severity(misses.withColumn("written", F.lit(None).cast("string")), adapter.gaps)))
    if adapter.schema is not None and adapter.syntax == "json":
        broken = validation.json_violations(nodes, adapter.schema)
        made.append(blank(broken.withColumns({"body": F.concat(F.lit("schema:"), F.col("keyword")), "severity": F.lit(findings.VIOLATION)})))
    if adapter.declared is not None:
        odd = findings.undeclared(out, adapter.declared)
        made.append(blank(odd.select(F.regexp_replace("rid", "/[^/]*$", "").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.substring_index("rid", "/", -1).cast("int").alias("record"), F.lit("").alias("path"), F.lit("undeclared").alias("body"), F.lit(findings.WARNING).alias("severity"), F.substring("p", 2, 9999).alias("value"))))
    none = blank(census.limit(0))
    names = docs.select("doc_id", x.ni_name(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("name"))
    return Conversion(out, versions, reduce(DataFrame.unionByName, made, none), errors, names)


def related(made: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of two blank-free graphs that the other lacks; none if they are equal as sets."""
    return construct.differences(made.select("s", "p", "o").distinct(), expected.select("s", "p", "o").distinct())
