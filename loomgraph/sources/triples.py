"""Triples from node tables, from relational tables, and from N-Triples files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as x
from loomgraph.functions import terms as t

# Namespaces of the public Facade-X vocabulary, and the DOM's name for text content.
FX = "http://sparql.xyz/facade-x/ns/"
XYZ = "http://sparql.xyz/facade-x/data/"
TEXT_CONTENT = "https://dom.spec.whatwg.org/#dom-node-textcontent"
TYPE = "I" + t.RDF + "type"


def record_id() -> Column:
    return F.concat_ws("/", F.col("doc_id").cast("string"), F.col("record").cast("string"))


def _node(pos: str = "pos") -> Column:
    return t.blank(F.concat(F.lit("n"), F.col(pos).cast("string")))


def _in_namespace() -> Column:
    return F.concat(F.when(F.col("ns") == "", F.lit(XYZ)).otherwise(F.col("ns")), F.col("name"))


def _member(slot: str = "slot") -> Column:
    return t.iri(F.concat(F.lit(t.RDF + "_"), F.col(slot).cast("string")))


# The unreserved characters of RFC 3987.
UNRESERVED = r"A-Za-z0-9\-._~\x{A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}" + "".join(rf"\x{{{k:X}0000}}-\x{{{k:X}FFFD}}" for k in range(1, 14)) + r"\x{E1000}-\x{EFFFD}"


def percent_encoded(name: Column) -> Column:
    """A member name in an IRI: characters outside the unreserved set of RFC 3987 are percent-encoded, run by run."""
    runs = F.regexp_extract_all(name, F.lit(f"[{UNRESERVED}]+|[^{UNRESERVED}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{UNRESERVED}]"), r).otherwise(x.encode_for_uri(r))), "")


def xml_triples(nodes: DataFrame) -> DataFrame:
    """(rid, s, p, o) of all records: types, roots, attributes and children in order. One pass over the nodes."""
    n = nodes.filter((F.col("record") >= 0) & F.col("kind").isin("element", "attribute", "text")).withColumn("rid", record_id())
    element, attribute, root = F.col("kind") == "element", F.col("kind") == "attribute", F.col("path") == ""
    one = lambda s, p, o: F.struct(s.alias("s"), p.alias("p"), o.alias("o"))
    of_element = F.array(
        one(_node(), F.lit(TYPE), t.iri(_in_namespace())),
        F.when(root, one(_node(), F.lit(TYPE), F.lit("I" + FX + "root"))).otherwise(one(_node("parent"), _member(), _node())),
    )
    of_attribute = F.array(one(_node("parent"), t.iri(_in_namespace()), t.plain(F.col("value"))))
    of_text = F.array(one(_node("parent"), _member(), t.plain(F.col("value"))))
    return n.select("rid", F.inline(F.when(element, of_element).when(attribute, of_attribute).otherwise(of_text)))


def text_content(nodes: DataFrame) -> DataFrame:
    """(doc_id, record, pos, text): the text below every element that has some, in document order.

    Every text node is sent to the elements around it, by their positions. The join is by sorting: files of nodes are many times
    smaller than their rows, so that their size would pass for small enough to be sent to every task."""
    sent = nodes.filter("kind = 'text'").select("doc_id", F.explode("above").alias("pos"), F.col("pos").alias("at"), "value")
    joined = sent.groupBy("doc_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda r: r["value"]), "").alias("text"))
    return nodes.filter("kind = 'element'").select("doc_id", "record", "pos").join(joined.hint("merge"), ["doc_id", "pos"]).select("doc_id", "record", "pos", "text")


def element_breaks(text: Column, mark: str) -> Column:
    """Runs between breaking elements: white space normalised, empty runs gone, joined by line feeds."""
    runs = F.transform(F.split(text, mark), lambda x: F.regexp_replace(F.btrim(x, F.lit(" \t\r\n")), "[ \t\r\n]+", " "))
    return F.array_join(F.filter(runs, lambda x: x != ""), "\n")


def decoded_attachment(content: Column) -> Column:
    """Base64 text, white space ignored; NULL where it is no canonical base64 or no UTF-8."""
    packed = F.regexp_replace(content, "[ \t\r\n]", "")
    raw = F.try_to_binary(packed, F.lit("base64"))
    return F.when(F.base64(raw) == packed, F.try_validate_utf8(raw.cast("string")))


def json_triples(nodes: DataFrame) -> DataFrame:
    """(rid, s, p, o) of all records: members by name, items by place; scalars as plain literals, nulls as nothing. One pass, no join."""
    n = nodes.filter((F.col("record") >= 0) & ~F.col("kind").isin("error", "null")).withColumn("rid", record_id())
    root = F.col("path") == ""
    name = F.when(F.col("parent_kind") == "array", _member()).otherwise(t.iri(F.concat(F.lit(XYZ), percent_encoded(F.col("name")))))
    value = F.when(F.col("kind").isin("object", "array"), _node()).otherwise(t.plain(F.col("value")))
    return n.select("rid", F.when(root, _node()).otherwise(_node("parent")).alias("s"), F.when(root, TYPE).otherwise(name).alias("p"), F.when(root, "I" + FX + "root").otherwise(value).alias("o"))


def skeleton(nodes: DataFrame) -> DataFrame:
    """The document around its records: of a record only its root, its attributes and children without children of their own."""
    parents = nodes.filter("kind IN ('element', 'object', 'array')").select("doc_id", F.col("parent").alias("pos")).distinct().withColumn("has_elements", F.lit(True))
    roots = nodes.filter("path = '' AND record >= 0").select("doc_id", F.col("pos").alias("parent")).distinct().withColumn("below_root", F.lit(True))
    marked = nodes.join(parents, ["doc_id", "pos"], "left").join(roots, ["doc_id", "parent"], "left")
    top = F.col("path") == ""
    near = F.col("below_root") & (F.col("has_elements").isNull()) & F.col("kind").isin("element", "attribute", "string", "number", "boolean")
    return marked.filter((F.col("record") < 0) | (top & F.col("kind").isin("element", "object")) | near).select(*nodes.columns)


def census(nodes: DataFrame) -> DataFrame:
    """doc_id, record, path, n and, of nodes with selectors, the one of the first place (within) of every path below the records' roots."""
    below = nodes.filter((F.col("record") >= 0) & (F.col("path") != "") & F.col("kind").isin("element", "attribute", "string", "number", "boolean", "object", "array"))
    within = [F.min_by("selector", "pos").alias("within")] if "selector" in nodes.columns else []
    return below.groupBy("doc_id", "record", "path").agg(F.count("*").alias("n"), *within)


def _row_terms(df: DataFrame, name: str, key: list[str], rid: str | None, links: dict[str, str], base: str) -> tuple[Column, Column, dict[str, Column]]:
    """Record, subject and, by predicate, the objects of a table's rows."""
    own = F.concat_ws("-", *(F.col(k).cast("string") for k in key))
    record = F.col(rid).cast("string") if rid else own
    kinds = {f.name: f.dataType.typeName() for f in df.schema}

    def term(c: str) -> Column:
        x = F.col(c).cast("string")
        if c in links:
            return t.iri(F.concat(F.lit(f"{base}{links[c]}:"), x))
        return t.integer(x) if kinds[c] in ("integer", "long", "short") else t.typed(x, t.XSD + "double") if kinds[c] == "double" else t.plain(x)

    return record, t.iri(F.concat(F.lit(f"{base}{name}:"), own)), {f"I{base}{name}#{c}": term(c) for c in df.columns}


def direct(df: DataFrame, name: str, key: list[str], rid: str | None = None, links: dict[str, str] = {}, base: str = "urn:table:") -> DataFrame:
    """A relational table as triples: a row is a subject, a column a predicate, NULL no triple.

    rid: the column whose value is the record of a row (else each row is one); links: columns that name rows of other tables."""
    record, subject, terms = _row_terms(df, name, key, rid, links, base)
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in terms.items()))
    rows = df.select(record.alias("rid"), subject.alias("s"), F.inline(pairs)).filter(F.col("o").isNotNull())
    types = df.select(record.alias("rid"), subject.alias("s"), F.lit(TYPE).alias("p"), F.lit(f"I{base}{name}").alias("o"))
    return rows.union(types)


def property_table(df: DataFrame, name: str, key: list[str], rid: str | None = None, links: dict[str, str] = {}, base: str = "urn:table:") -> DataFrame:
    """The triples of ``direct`` with a row a subject: rid, s, and the object of every predicate in a column of its name, NULL no triple.

    The key must tell all rows apart, so that no subject has two rows. Patterns that share a subject then need no join (``patterns.star``)."""
    record, subject, terms = _row_terms(df, name, key, rid, links, base)
    return df.select(record.alias("rid"), subject.alias("s"), F.lit(f"I{base}{name}").alias(TYPE), *(o.alias(p) for p, o in terms.items()))


def unescaped(text: Column) -> Column:
    """N-Triples escapes: \\t \\b \\n \\r \\f \\" \\' \\\\, and \\u and \\U with the code point in hex."""
    parts = F.regexp_extract_all(text, F.lit(r"\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|\\.|[^\\]+"), F.lit(0))
    plain = dict(zip("tbnrf", "\t\b\n\r\f", strict=True))

    def one(part: Column) -> Column:
        code = F.decode(F.unhex(F.lpad(F.substring(part, 3, 8), 8, "0")), "UTF-32")
        out = F.when(part.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), code)
        for mark, char in plain.items():
            out = out.when(part == "\\" + mark, char)
        return out.when(F.startswith(part, F.lit("\\")), F.substring(part, 2, 2147483647)).otherwise(part)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def parsed_n_triples(lines: DataFrame) -> DataFrame:
    """s, p, o of N-Triples lines (column value); comments and blank lines are skipped, lines that are no triple raise."""
    part = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
    line = rf"^\s*{part}\s+{part}\s+{part}\s*\.\s*(?:#.*)?$"
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    checked = rows.withColumn("value", F.when(F.col("value").rlike(line), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no triple: "), F.col("value")))))

    def term(k: int) -> Column:
        x = F.regexp_extract("value", line, k)
        lit = r'^"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?$'
        text = unescaped(F.regexp_extract(x, lit, 1))
        kind, tag = unescaped(F.regexp_extract(x, lit, 2)), F.regexp_extract(x, lit, 3)
        return (
            F.when(F.startswith(x, F.lit("<")), t.iri(unescaped(F.substring(x, F.lit(2), F.length(x) - 2))))
            .when(F.startswith(x, F.lit("_:")), t.blank(F.substring(x, 3, 2147483647)))
            .when(tag != "", F.concat(F.lit("L"), tag, F.lit(t.NUL), text))
            .when((kind != "") & (kind != t.XSD + "string"), F.concat(F.lit("T"), kind, F.lit(t.NUL), text))
            .otherwise(t.plain(text))
        )

    return checked.select(*lines.drop("value").columns, term(1).alias("s"), term(2).alias("p"), term(3).alias("o"))


def read_n_triples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of an N-Triples file."""
    return parsed_n_triples(spark.read.text(path))


def write_n_triples(quads: DataFrame, path: str) -> None:
    """Each triple once, as a text file set."""
    line = F.concat_ws(" ", *(t.n_triple(F.col(c)) for c in ("s", "p", "o")), F.lit("."))
    quads.select(line.alias("value")).distinct().write.mode("overwrite").text(path)
