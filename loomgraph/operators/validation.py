"""Checks of sources and outputs as DataFrame conditions: JSON Schema keywords, SHACL constraints, XSD occurrences.

A schema is a mapping that the driver reads; every keyword becomes one column condition, and all of them are checked in
one pass. Keywords that are not supported raise when the check is built, never pass silently.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import terms as t


def json_equal(value: Column, kind: Column, want) -> Column:
    """Is a JSON scalar (its text and its kind) equal to a value of the schema? By kind, and numbers by value: 1.0 is 1, "1" is not."""
    if want is None:
        return kind == "null"
    if isinstance(want, bool):
        return (kind == "boolean") & (value == str(want).lower())
    if isinstance(want, int | float):
        exact = value.try_cast("decimal(38,18)") == F.lit(str(want)).cast("decimal(38,18)")
        return (kind == "number") & F.coalesce(exact, value.try_cast("double") == F.lit(float(want)), F.lit(False))
    if isinstance(want, str):
        return (kind == "string") & (value == want)
    raise ValueError("only scalars can be compared")


def json_keyword(value: Column, kind: Column, keyword: str, want) -> Column:
    """True where a JSON value (its text and its kind) breaks a keyword; values of another kind don't."""
    number = F.when(kind == "number", value.try_cast("decimal(38,18)"))
    is_text = kind == "string"
    size = F.char_length(value)
    broken = {
        "type": lambda: ~(kind.isin(*([want] if isinstance(want, str) else want)) | (F.lit("integer" in want) & (kind == "number") & (number == F.floor(number)))),
        "enum": lambda: ~reduce(or_, (F.coalesce(json_equal(value, kind, w), F.lit(False)) for w in want), F.lit(False)),
        "const": lambda: ~F.coalesce(json_equal(value, kind, want), F.lit(False)),
        "minimum": lambda: number < F.lit(want),
        "maximum": lambda: number > F.lit(want),
        "exclusiveMinimum": lambda: number <= F.lit(want),
        "exclusiveMaximum": lambda: number >= F.lit(want),
        "multipleOf": lambda: number % F.lit(want).cast("decimal(38,18)") != 0,
        "minLength": lambda: is_text & (size < want),
        "maxLength": lambda: is_text & (size > want),
        "pattern": lambda: is_text & ~value.rlike(want),
    }
    if keyword not in broken:
        raise ValueError(f"keyword {keyword} is not supported")
    return F.coalesce(broken[keyword](), F.lit(False))


def json_violations(nodes: DataFrame, schema: dict) -> DataFrame:
    """doc_id, record, path, keyword: what each record breaks. schema: keywords on values, and required, minItems, maxItems, uniqueItems,
    minProperties, maxProperties, items (one schema) and properties, nested to any depth."""
    of_value, of_node = [], []

    def read(schema: dict, path: str, item: bool) -> None:
        """Rules by the path of a node, and whether it is an item of an array there (items stand at the array's own path)."""
        for k, v in schema.items():
            if k == "properties":
                for name, inner in v.items():
                    read(inner, f"{path}/{name}", False)
            elif k == "items":
                read(v, path, True)
            elif k in ("required", "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties"):
                of_node.append((path, item, k, v))
            else:
                of_value.append((path, item, k, v))

    read(schema, "", False)
    inside = nodes.filter("record >= 0 AND kind <> 'error'")
    value, kind = F.col("value"), F.col("kind")
    is_item = F.coalesce(F.col("parent_kind") == "array", F.lit(False)) & (F.col("path") != "")
    here = lambda p, item: (F.col("path") == p) & (is_item if item else ~is_item)
    none = F.array().cast("array<string>")
    checks = F.array(*(F.when(here(p, i) & json_keyword(value, kind, k, v), F.lit(k)) for p, i, k, v in of_value)) if of_value else none
    found = inside.select("doc_id", "record", "path", F.explode(F.array_compact(checks)).alias("keyword"))
    if not of_node:
        return found
    # What a container holds: its members' names and its items, by its position.
    same_value = F.coalesce(F.when(kind == "number", value.try_cast("decimal(38,18)").cast("string")), value)
    # A set and not count(distinct), which would send every item of every container over the network.
    scalar = F.when(~kind.isin("object", "array"), F.struct("kind", same_value.alias("value")))
    distinct = F.size(F.collect_set(scalar)) if any(k == "uniqueItems" and v for _, _, k, v in of_node) else F.lit(0)
    held = inside.filter("path <> '' OR parent_kind = 'array'").groupBy("doc_id", F.col("parent").alias("pos")).agg(F.collect_set("name").alias("names"), F.count("*").alias("n"), distinct.alias("distinct_scalars"), F.count_if(~kind.isin("object", "array")).alias("scalars"))
    asked = inside.filter("kind IN ('object', 'array')").join(held, ["doc_id", "pos"], "left")
    n, names = F.coalesce("n", F.lit(0)), F.coalesce("names", none)
    is_object, is_array = kind == "object", kind == "array"
    broken = {
        "required": lambda v: is_object & (F.size(F.array_except(F.array(*map(F.lit, v)), names)) > 0) if v else F.lit(False),
        "minItems": lambda v: is_array & (n < v),
        "maxItems": lambda v: is_array & (n > v),
        "uniqueItems": lambda v: is_array & F.lit(bool(v)) & (F.coalesce("scalars", F.lit(0)) > F.coalesce("distinct_scalars", F.lit(0))),
        "minProperties": lambda v: is_object & (F.size(names) < v),
        "maxProperties": lambda v: is_object & (F.size(names) > v),
    }
    of_container = F.array(*(F.when(here(p, i) & broken[k](v), F.lit(k)) for p, i, k, v in of_node))
    return found.union(asked.select("doc_id", "record", "path", F.explode(F.array_compact(of_container)).alias("keyword")))


def shacl(quads: DataFrame, target: str, path: str, min_count: int | None = None, max_count: int | None = None, max_length: int | None = None, pattern: str | None = None, datatype: str | None = None, values: list[str] | None = None) -> DataFrame:
    """rid, focus, component: constraints of one property shape on the nodes of a class."""
    focus = quads.filter((F.col("p") == "I" + t.RDF + "type") & (F.col("o") == target)).select("rid", F.col("s").alias("focus")).distinct()
    found = quads.filter(F.col("p") == path).select("rid", F.col("s").alias("focus"), "o")
    joined = focus.join(found, ["rid", "focus"], "left")
    text = t.lexical(F.col("o"))
    of_value = [
        ("MaxLength", None if max_length is None else F.length(text) > max_length),
        ("Pattern", None if pattern is None else ~text.rlike(pattern)),
        ("Datatype", None if datatype is None else F.coalesce(t.datatype(F.col("o")) != datatype, F.lit(True))),
        ("In", None if values is None else ~F.col("o").isin(*values)),
    ]
    n = F.count_distinct("o")
    counts = joined.groupBy("rid", "focus").agg(n.alias("n"))
    of_count = [("MinCount", None if min_count is None else F.col("n") < min_count), ("MaxCount", None if max_count is None else F.col("n") > max_count)]

    def broken(df: DataFrame, checks) -> DataFrame:
        used = [F.when(c, F.lit(name)) for name, c in checks if c is not None]
        return df.select("rid", "focus", F.explode(F.array_compact(F.array(*used) if used else F.array().cast("array<string>"))).alias("component"))

    return broken(joined.filter("o IS NOT NULL").distinct(), of_value).union(broken(counts, of_count))


def occurrences(nodes: DataFrame, parent: str, required_attributes: list[str] = (), children: dict[str, tuple[int, int | None]] = {}) -> DataFrame:
    """doc_id, record, selector (of nodes that have it), rule: XSD occurrences on elements of a name. children: name to (least, most)."""
    selector = ["selector"] if "selector" in nodes.columns else []
    elements = nodes.filter((F.col("kind") == "element") & (F.col("name") == parent)).select("doc_id", "record", "pos", *selector)
    below = nodes.filter(F.col("kind").isin("element", "attribute")).select("doc_id", F.col("parent").alias("pos"), "kind", "name")
    attribute = lambda a: F.count_if((F.col("kind") == "attribute") & (F.col("name") == a))
    child = lambda c: F.count_if((F.col("kind") == "element") & (F.col("name") == c))
    known = F.count_if((F.col("kind") == "element") & ~F.col("name").isin(*children)) if children else F.lit(0)
    joined = elements.join(below, ["doc_id", "pos"], "left").groupBy("doc_id", "record", "pos", *selector)
    checks = [F.when(attribute(a) < 1, F.lit(f"attribute {a} is required")) for a in required_attributes]
    for c, (least, most) in children.items():
        checks.append(F.when(child(c) < least, F.lit(f"too few {c}")))
        if most is not None:
            checks.append(F.when(child(c) > most, F.lit(f"too many {c}")))
    checks.append(F.when(known > 0, F.lit("element is not declared")))
    return joined.agg(F.array_compact(F.array(*checks)).alias("rules")).select("doc_id", "record", *selector, F.explode("rules").alias("rule"))


def unresolved(addresses: DataFrame, nodes: DataFrame) -> DataFrame:
    """Addresses (doc_id, selector) that don't select exactly one node of their document."""
    n = nodes.filter("kind NOT IN ('attribute', 'text', 'error')").groupBy("doc_id", "selector").agg(F.count("*").alias("n"))
    return addresses.join(n, ["doc_id", "selector"], "left").filter("n IS NULL OR n <> 1").drop("n")
