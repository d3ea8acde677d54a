"""RDF terms as tagged strings, and SPARQL's comparisons over them as Spark columns.

A term is one string: ``I`` + IRI, ``B`` + blank label, ``S`` + plain string, ``T`` + datatype + NUL + lexical form, ``L`` +
language + NUL + text. Equal strings are the same term, so joins and distinct work on terms as they are, in
generated code. NULL is an unbound variable or an error; the functions here keep the two rules that plain
SQL logic lacks (effective boolean values, and values that can't be compared).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces and names of RDF and XML Schema.
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
NUL = "\0"

NUMERIC = tuple(
    XSD + t for t in ("integer", "decimal", "float", "double", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def iri(text) -> Column:
    return F.concat(F.lit("I"), _c(text).cast("string"))


def blank(label) -> Column:
    return F.concat(F.lit("B"), _c(label).cast("string"))


def plain(text) -> Column:
    return F.concat(F.lit("S"), _c(text).cast("string"))


def typed(lexical, datatype: str) -> Column:
    return F.concat(F.lit("T" + datatype + NUL), _c(lexical).cast("string"))


def integer(lexical) -> Column:
    return typed(lexical, XSD + "integer")


def tagged(text, language: str) -> Column:
    return F.concat(F.lit("L" + language + NUL), _c(text).cast("string"))


def kind(term: Column) -> Column:
    return F.left(term, F.lit(1))


def _two(term: Column) -> Column:
    return kind(term).isin("T", "L")


def lexical(term: Column) -> Column:
    """The text of any term; blank labels included."""
    return F.when(_two(term), F.substring(term, F.instr(term, NUL) + 1, F.length(term))).otherwise(F.substring(term, 2, 2147483647))


def datatype(term: Column) -> Column:
    """IRI of a literal's datatype; NULL for others."""
    return (
        F.when(kind(term) == "S", F.lit(XSD + "string"))
        .when(kind(term) == "L", F.lit(RDF + "langString"))
        .when(kind(term) == "T", F.substring(term, F.lit(2), F.instr(term, NUL) - 2))
    )


def language(term: Column) -> Column:
    """A literal's language, '' if it has none; NULL for IRIs and blank nodes."""
    return F.when(kind(term) == "L", F.substring(term, F.lit(2), F.instr(term, NUL) - 2)).when(kind(term).isin("S", "T"), "")


def is_numeric(term: Column) -> Column:
    return datatype(term).isin(*NUMERIC)


def number(term: Column) -> Column:
    """Value of a numeric literal; NULL for all else."""
    return F.when(is_numeric(term), lexical(term).try_cast("double"))


def whole(term: Column) -> Column:
    """Exact value of an integer literal of up to 38 digits; NULL for all else. Doubles can't tell neighbours above 2**53 apart."""
    x = lexical(term)
    return F.when(is_numeric(term) & ~datatype(term).isin(*(XSD + t for t in ("decimal", "float", "double"))) & x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("decimal(38,0)"))


def text_of(term: Column) -> Column:
    """STR: the text of an IRI or a literal; a blank node is an error."""
    return F.when(kind(term) != "B", lexical(term))


def string_literal(term: Column) -> Column:
    """Text of a literal that string functions take: plain or with a language; NULL, an error, for all else."""
    return F.when(kind(term).isin("S", "L"), lexical(term))


def truth(term: Column) -> Column:
    """Effective boolean value: strings by length, numbers by value, booleans by themselves, NULL (an error) for the rest."""
    x = lexical(term)
    return (
        F.when(kind(term).isin("S", "L"), F.length(x) > 0)
        .when(datatype(term) == XSD + "boolean", x.isin("true", "1"))
        .when(is_numeric(term), F.coalesce((number(term) != 0) & ~F.isnan(number(term)), F.lit(False)))
    )


def boolean(condition: Column) -> Column:
    """A condition as a boolean literal, unbound where it is an error."""
    return F.when(condition, F.lit("T" + XSD + "boolean" + NUL + "true")).when(~condition, F.lit("T" + XSD + "boolean" + NUL + "false"))


def moment(term: Column) -> Column:
    return F.when(datatype(term) == XSD + "dateTime", F.try_to_timestamp(lexical(term)))


def equal(a: Column, b: Column) -> Column:
    """SPARQL '=': by value for numbers, booleans and dateTimes, by term for the rest; NULL where two different literals can't be told apart."""
    known = lambda t: kind(t).isin("I", "B", "S", "L") | is_numeric(t) | datatype(t).isin(XSD + "boolean", XSD + "dateTime")
    same_type = datatype(a) == datatype(b)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean"))
        .when(a == b, True)
        .when(is_numeric(a) & is_numeric(b), F.coalesce(whole(a) == whole(b), number(a) == number(b)))
        .when(same_type & (datatype(a) == XSD + "boolean"), truth(a) == truth(b))
        .when(same_type & (datatype(a) == XSD + "dateTime"), moment(a) == moment(b))
        .when(kind(a).isin("I", "B") | kind(b).isin("I", "B"), False)
        .when(known(a) & known(b) & (kind(a) != "T") & (kind(b) != "T"), False)
    )


def comparable(term: Column) -> Column:
    """What '<' reads of a term: whole number, number, plain string or dateTime; all NULL for a term that has no order.

    Before a join that compares, it is worked out once a row; inside the join's condition, once a pair."""
    return F.struct(whole(term).alias("whole"), number(term).alias("number"), F.when(kind(term) == "S", lexical(term)).alias("text"), moment(term).alias("moment"))


def precedes(a: Column, b: Column) -> Column:
    """SPARQL '<' of two terms given as ``comparable``."""
    return F.coalesce(*(a[k] < b[k] for k in ("whole", "number", "text", "moment")))


def less(a: Column, b: Column) -> Column:
    """SPARQL '<' over numbers, plain strings and dateTimes; NULL for other pairs."""
    return precedes(comparable(a), comparable(b))


def sort_key(term: Column) -> Column:
    """Order of terms: unbound, blank nodes, IRIs, literals; numbers by value, the rest by code points."""
    rank = F.when(term.isNull(), 0).when(kind(term) == "B", 1).when(kind(term) == "I", 2).otherwise(3)
    return F.struct(rank.alias("rank"), number(term).alias("number"), whole(term).alias("whole"), lexical(term).alias("text"))


def is_in(term: Column, *items: Column) -> Column:
    """IN: true if any item is equal by value; else an error if any comparison was one; else false."""
    hits = [equal(term, i) for i in items]
    if not hits:
        return F.lit(False)
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def n_triple(term: Column) -> Column:
    """A term as N-Triples writes it."""
    esc = F.replace(F.replace(F.replace(F.replace(lexical(term), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    quoted = F.concat(F.lit('"'), esc, F.lit('"'))
    return (
        F.when(kind(term) == "I", F.concat(F.lit("<"), lexical(term), F.lit(">")))
        .when(kind(term) == "B", F.concat(F.lit("_:"), lexical(term)))
        .when(kind(term) == "S", quoted)
        .when(kind(term) == "L", F.concat(quoted, F.lit("@"), language(term)))
        .when(kind(term) == "T", F.concat(quoted, F.lit("^^<"), datatype(term), F.lit(">")))
    )
