"""XML and JSON documents as node tables. Python only parses; everything after is DataFrame work on the nodes.

Nodes: doc_id, record (-1 outside records), pos (document order), parent (pos), kind, ns, name, slot (place among the
parent's element and text children, from 1), nth (place among same-named siblings, from 1), value, selector, path,
parent_kind (NULL at the root), above (positions of all elements around a text node, NULL for other nodes).
XML kinds: element, attribute, text. JSON kinds: object, array, string, number, boolean, null. A document
that can't be read has one row of kind error with the reason as its value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("record", "pos", "parent", "kind", "ns", "name", "slot", "nth", "value", "selector", "path", "parent_kind", "above")
SCHEMA = "record int, pos int, parent int, kind string, ns string, name string, slot int, nth int, value string, selector string, path string, parent_kind string, above array<int>"
KINDS = [pa.int32()] * 3 + [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()] * 4 + [pa.list_(pa.int32())]
XML_SPACE = " \t\r\n"


def _error(reason: str) -> list[tuple]:
    return [(-1, 0, -1, "error", "", "", 0, 1, reason, "", "", None, None)]


def _step(ns: str, local: str) -> str:
    """An element in an XPath: by its name, or by name and namespace where it has one."""
    if not ns:
        return local
    quote = '"' if "'" in ns else "'"
    return f"*[local-name()='{local}' and namespace-uri()={quote}{ns}{quote}]"


class _Xml:
    """Expat events to node rows. Outermost elements named ``unit`` are records. ``full``: with selectors and the elements around texts."""

    def __init__(self, unit: str, full: bool = True):
        self.unit, self.full, self.rows, self.stack, self.text, self.record, self.records, self.pos = unit, full, [], [], [], -1, 0, 0

    def flush(self):
        text, self.text = "".join(self.text), []
        if self.stack and text.strip(XML_SPACE):
            top = self.stack[-1]
            top[SLOTS] += 1
            above = [x[POS] for x in self.stack] if self.full else None
            self.rows.append((self.record, self.pos, top[POS], "text", "", "", top[SLOTS], 1, text, top[SELECTOR], top[PATH], "element", above))
            self.pos += 1

    def start(self, name, attributes):
        if self.text:
            self.flush()
        ns, _, local = name.rpartition(" ")
        own = self.record < 0 and local == self.unit
        if own:
            self.record, self.records = self.records, self.records + 1
        pos, selector, path = self.pos, None, ""
        if self.stack:
            top = self.stack[-1]
            top[SLOTS] = slot = top[SLOTS] + 1
            names = top[NAMES]
            names[name] = nth = names.get(name, 0) + 1
            if self.full:
                selector = f"{top[SELECTOR]}/{_step(ns, local)}[{nth}]"
            if self.record >= 0 and not own:
                path = f"{top[PATH]}/{local}"
            self.rows.append((self.record, pos, top[POS], "element", ns, local, slot, nth, None, selector, path, "element", None))
        else:
            if self.full:
                selector = f"/{_step(ns, local)}"
            self.rows.append((self.record, pos, -1, "element", ns, local, 1, 1, None, selector, path, None, None))
        self.stack.append([pos, 0, {}, selector, path, own])
        for k in range(0, len(attributes), 2):
            a_ns, _, a = attributes[k].rpartition(" ")
            pos += 1
            self.rows.append((self.record, pos, self.pos, "attribute", a_ns, a, 0, 1, attributes[k + 1], selector, f"{path}/@{a}", "element", None))
        self.pos = pos + 1

    def end(self, name):
        if self.text:
            self.flush()
        if self.stack.pop()[OWN]:
            self.record = -1


#: What an open element holds: its position, children so far, its children's names, its selector and path, and whether it is a record.
POS, SLOTS, NAMES, SELECTOR, PATH, OWN = range(6)
#: Bytes of a document that are parsed, or nodes that are kept, before rows go out.
BLOCK, ROWS = 1 << 20, 1 << 14


def parse_xml(text: str | None, unit: str, full: bool = True) -> Iterator[list[tuple]]:
    """Rows of one document in blocks; of a document over a block the whole is checked before any row goes out."""
    x, parser = _Xml(unit, full), expat.ParserCreate(namespace_separator=" ")
    parser.ordered_attributes = parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = x.start, x.end
    parser.CharacterDataHandler = lambda s: x.text.append(s)
    try:
        data = (text or "").encode()
        if len(data) > BLOCK:
            expat.ParserCreate(namespace_separator=" ").Parse(data, True)
            for k in range(0, len(data), BLOCK):
                parser.Parse(data[k : k + BLOCK], False)
                yield x.rows
                x.rows = []
            data = b""
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError) as e:
        yield _error(str(e))
    else:
        yield x.rows


class _Number(str):
    """A number as written."""


def _refuse(x: str):
    raise ValueError(f"{x} is no JSON")


#: Containers that may stand in each other.
DEEPEST = 512
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def _too_deep(text: str) -> bool:
    if text.count("[") + text.count("{") <= DEEPEST:
        return False
    depth = 0
    for mark in re.findall(r"[\[\]{}]", re.sub(r'"(?:[^"\\]|\\.)*"', "", text, flags=re.S)):
        depth += 1 if mark in "[{" else -1
        if depth > DEEPEST:
            return True
    return False


def parse_json(text: str | None, split: str | None, full: bool = True) -> Iterator[list[tuple]]:
    """split: None (the root is the record) or the member whose array items are the records; only objects are records.

    Rows in blocks. A document that is no JSON, is over 512 levels deep, or has a lone surrogate is one row of kind error."""
    text = text or ""
    try:
        text.encode("utf-8")
        if _too_deep(text):
            raise ValueError(f"over {DEEPEST} levels deep")
        root = json.loads(text, object_pairs_hook=lambda pairs: ("object", pairs), parse_float=_Number, parse_int=_Number, parse_constant=_refuse)
        if not isinstance(root, tuple | list):
            raise ValueError("the root is neither object nor array")
        if _SURROGATE.search(text):
            for rows in _json_rows(root, split, False):
                for row in rows:
                    f"{row[5]}{row[8]}".encode("utf-8")
    except UnicodeEncodeError:
        yield _error("a lone surrogate")
    except (ValueError, RecursionError) as e:
        yield _error(str(e))
    else:
        yield from _json_rows(root, split, full)


def _json_rows(root, split: str | None, full: bool) -> Iterator[list[tuple]]:
    """Nodes in document order, from an explicit stack."""
    rows: list[tuple] = []
    records = pos = 0
    # value, parent, parent's kind, name, slot, nth, pointer, record, path, and whether an object here is a record
    stack = [(root, -1, None, "", 1, 1, "#" if full else None, 0 if split is None and isinstance(root, tuple) else -1, "", False)]
    while stack:
        x, parent, parent_kind, name, slot, nth, pointer, record, path, may_be_record = stack.pop()
        value = None
        if isinstance(x, _Number):
            kind, value = "number", str(x)
        elif isinstance(x, str):
            kind = "string"
            value = x
        elif x is None:
            kind = "null"
        elif isinstance(x, tuple):
            kind = "object"
            if may_be_record:
                record, records = records, records + 1
            inner, seen = [], {}
            for k, (key, v) in enumerate(x[1], 1):
                seen[key] = seen.get(key, 0) + 1
                splits = split is not None and parent < 0 and key == split and isinstance(v, list)
                inner.append((v, pos, kind, key, k, seen[key], f"{pointer}/{key.replace('~', '~0').replace('/', '~1')}" if full else None, -1 if splits else record, "" if splits else f"{path}/{key}", False))
            stack.extend(reversed(inner))
        elif isinstance(x, list):
            kind = "array"
            records_here = split is not None and parent == 0 and parent_kind == "object" and record < 0 and name == split
            stack.extend((x[k], pos, kind, str(k + 1), k + 1, 1, f"{pointer}/{k}" if full else None, record, path, records_here) for k in range(len(x) - 1, -1, -1))
        else:
            kind, value = "boolean", str(x).lower()
        rows.append((record, pos, parent, kind, "", name, slot, nth, value, pointer, path, parent_kind, None))
        pos += 1
        if len(rows) >= ROWS:
            yield rows
            rows = []
    yield rows


def _nodes(docs: DataFrame, id_col: str, text_col: str, parse, columns: Iterable[str] | None, kinds: Iterable[str] | None) -> DataFrame:
    """columns and kinds: those that are asked for (all if None); others are not made. Errors always are."""
    asked = None if kinds is None else {*kinds, "error"}
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = FIELDS if columns is None else tuple(f for f in FIELDS if f in set(columns))
    places = [FIELDS.index(f) for f in wanted]
    full = not {"selector", "above"}.isdisjoint(wanted)

    def run(batches):
        for batch in batches:
            rows, owner, ids = [], [], batch.column(0)

            def sent():
                columns = list(zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), *(pa.array(columns[i], KINDS[i]) for i in places)], names=["doc_id", *wanted])

            for k in range(batch.num_rows):
                for block in parse(batch.column(1)[k].as_py(), full):
                    if asked is not None:
                        block = [row for row in block if row[3] in asked]
                    rows += block
                    owner += [k] * len(block)
                    if len(rows) >= ROWS:
                        yield sent()
                        rows, owner = [], []
            if rows:
                yield sent()

    types = dict(zip(FIELDS, SCHEMA.split(", "), strict=True))
    return base.mapInArrow(run, ", ".join([f"doc_id {base.schema['doc_id'].dataType.simpleString()}", *(types[f] for f in wanted)]))


def xml_nodes(docs: DataFrame, unit: str, id_col: str = "doc_id", text_col: str = "text", columns: Iterable[str] | None = None, kinds: Iterable[str] | None = None) -> DataFrame:
    return _nodes(docs, id_col, text_col, lambda text, full: parse_xml(text, unit, full), columns, kinds)


def json_nodes(docs: DataFrame, split: str | None = None, id_col: str = "doc_id", text_col: str = "text", columns: Iterable[str] | None = None, kinds: Iterable[str] | None = None) -> DataFrame:
    return _nodes(docs, id_col, text_col, lambda text, full: parse_json(text, split, full), columns, kinds)
