"""Data-quality findings as flat rows: doc_id, record, path, within, n, body, severity, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as x
from loomgraph.functions import terms as t

INFO, WARNING, VIOLATION = "Info", "Warning", "Violation"
REPORTED_VERDICTS = ("noHome", "carriedInPart")
REPORTED_KINDS = ("noPredicate", "sourceLacksRequired")


def unaccounted(census: DataFrame, accounting: DataFrame) -> DataFrame:
    """Paths that no accounting entry carries, with their first place and count."""
    return census.join(accounting.select("path"), "path", "left_anti").withColumns({"body": F.lit("unaccounted"), "severity": F.lit(INFO)})


def declared_gaps(census: DataFrame, accounting: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gaps at paths that occur, where verdict and kind of gap are of those that are reported."""
    entries = accounting.filter(F.col("verdict").isin(*REPORTED_VERDICTS)).join(gaps.filter(F.col("kind").isin(*REPORTED_KINDS)), "gap")
    return census.join(entries.select("path", "gap", "severity"), "path").select(*census.columns, F.col("gap").alias("body"), F.coalesce("severity", F.lit(INFO)).alias("severity"))


def lookup_misses(held: DataFrame, accounting: DataFrame, notations: DataFrame) -> DataFrame:
    """Values at looked-up paths whose key is in no notation of the map; empty values are skipped."""
    asked = held.join(accounting.filter("lookup IS NOT NULL").select("path", F.col("lookup").alias("map"), F.col("miss_gap").alias("body")), "path")
    asked = asked.withColumn("key", x.lookup_key(F.col("value"))).filter("key <> ''")
    known = notations.select("map", x.lookup_key(F.col("notation")).alias("key")).distinct()
    return asked.join(known, ["map", "key"], "left_anti")


def with_severity(findings: DataFrame, gaps: DataFrame, written: str = "written") -> DataFrame:
    """Severity as written, else that of the body's gap, else Info."""
    known = gaps.select(F.col("gap").alias("body"), F.col("severity").alias("__declared"))
    return findings.join(known, "body", "left").withColumn("severity", F.coalesce(written, "__declared", F.lit(INFO))).drop("__declared")


def undeclared(quads: DataFrame, declared: DataFrame) -> DataFrame:
    """Predicates that no vocabulary declares, once a record. Declared ones go first, so only what is left is held to be made distinct."""
    return quads.select("rid", "p").join(declared.select("p"), "p", "left_anti").select("p", "rid").distinct()


# Namespaces of the Web Annotation and SHACL vocabularies, and what a JSON Pointer selector conforms to.
OA, SH = "http://www.w3.org/ns/oa#", "http://www.w3.org/ns/shacl#"
CONFORMS_TO, JSON_POINTER = "http://purl.org/dc/terms/conformsTo", "https://www.rfc-editor.org/rfc/rfc6901"


def _one(s: Column, p: str, o: Column) -> Column:
    return F.struct(s.alias("s"), F.lit("I" + p).alias("p"), o.alias("o"))


def selector_triples(node: Column, value: Column) -> list[Column]:
    """A selector node: an XPath, or a URI fragment that holds a JSON Pointer. NULL values give triples without an object, which go."""
    pointer = F.startswith(value, F.lit("#"))
    kind = F.when(pointer, F.lit("I" + OA + "FragmentSelector")).when(~pointer, F.lit("I" + OA + "XPathSelector"))
    return [_one(node, t.RDF + "type", kind), _one(node, CONFORMS_TO, F.when(pointer, F.lit("I" + JSON_POINTER))), _one(node, t.RDF + "value", t.plain(value))]


def as_triples(findings: DataFrame) -> DataFrame:
    """Flat findings as annotation triples (rid, s, p, o); the count only where it is over one.

    With columns document and selector, the target has its document as source and a selector of its own, and where there is a column
    within, the selector is refined by the address inside the record."""
    names = findings.columns
    own = [c for c in ("document", "selector", "within") if c in names]
    node = x.stable_label(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rid", "path", "body", "value", *own)))
    a, target, selector, inner = t.blank(node), t.blank(F.concat(node, F.lit("t"))), t.blank(F.concat(node, F.lit("s"))), t.blank(F.concat(node, F.lit("r")))
    triples = [
        _one(a, t.RDF + "type", F.lit("I" + OA + "Annotation")),
        _one(a, OA + "hasTarget", target),
        _one(a, OA + "hasBody", t.iri(F.concat(F.lit("urn:gap:"), F.col("body")))),
        _one(a, SH + "resultSeverity", t.iri(F.concat(F.lit(SH), F.col("severity")))),
        _one(a, t.RDF + "value", t.plain(F.col("value"))),
        _one(a, "urn:loomgraph:count", F.when(F.col("n") > 1, t.integer(F.col("n")))),
    ]
    if "document" in names:
        triples += [_one(a, OA + "motivatedBy", F.lit("I" + OA + "classifying")), _one(target, OA + "hasSource", t.iri(F.col("document")))]
    if "selector" in names:
        triples += [_one(target, OA + "hasSelector", F.when(F.col("selector").isNotNull(), selector)), *selector_triples(selector, F.col("selector"))]
    if "within" in names:
        triples += [_one(selector, OA + "refinedBy", F.when(F.col("within").isNotNull(), inner)), *selector_triples(inner, F.col("within"))]
    return findings.select("rid", F.inline(F.array(*triples))).filter(F.col("o").isNotNull())


def dropped_versions(gone: DataFrame) -> DataFrame:
    """A warning for each version that was not kept: rid, path, body, severity, value (the name that was kept), selector, n."""
    return gone.select("rid", F.lit("").alias("path"), F.lit("versionNotKept").alias("body"), F.lit(WARNING).alias("severity"), F.col("kept_name").alias("value"), "selector", F.lit(1).alias("n"))
