"""Chat formatting by columnar byte assembly.

All turns of a batch become one buffer: the lengths of headers, contents and ends give cumulative offsets, these give
gather indices, and one gather copies everything into one preallocated array, which is the data buffer of the
Arrow column. Control strings inside texts get a backslash after their first character (and one more
where there are backslashes already), which reading back undoes exactly.

A turn is ``<|turn|>role\\ntext<|end|>\\n``; in a role, backslashes and newlines are escaped first. Turns of a
conversation meet by one shuffle on its id and are streamed in order of turn, role and text; a conversation
may span any number of batches, and one that is too long for a row is written in numbered chunks.

Defined results: a null text or role counts as empty; null ids are one conversation; equal turns stay, in order;
repeated rows are repeated turns; a very long text is one turn of any size up to a row's 2 GB; other columns, whatever their names, are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SLICE_BYTES, buffers, sliced, small_batches

TURN, END = b"<|turn|>", b"<|end|>\n"
#: What must not stand in a text as it is: this template's marks, and marks of other common templates.
CONTROL = re.compile(rb"([<\[])(\\*)(\|(?:turn|end|im_start|im_end|endoftext)\|>|/?s>|</?SYS>>|/?INST\])")
ESCAPED = re.compile(r"([<\[])(\\*)\\(\|(?:turn|end|im_start|im_end|endoftext)\|>|/?s>|</?SYS>>|/?INST\])")
#: The same, as a pattern for SQL.
CONTROL_SQL = r"([<\[])(\\*)(\|(?:turn|end|im_start|im_end|endoftext)\|>|/?s>|</?SYS>>|/?INST\])"


def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column of texts with a backslash put into every control string, and its offsets."""
    places = [m.start() + 1 for m in CONTROL.finditer(data.tobytes()) if np.searchsorted(offsets, m.start(), "right") == np.searchsorted(offsets, m.end() - 1, "right")]
    if not places:
        return data, offsets
    return np.insert(data, places, 0x5C), offsets + np.searchsorted(places, offsets, "right")


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def role_header(role: str | None) -> bytes:
    plain = (role or "").replace("\\", "\\\\").replace("\n", "\\n").encode()
    data, _ = escaped(np.frombuffer(plain, np.uint8), np.array([0, len(plain)]))
    return TURN + data.tobytes() + b"\n"


def role_of(header: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(header), flags=re.S)


def assembled(roles: list[str | None], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns as one buffer: the bytes, the offset of each turn, and start and end of each content in them."""
    data, offsets = escaped(data, offsets)
    kinds = list(dict.fromkeys(roles))
    headers = [role_header(x) for x in kinds]
    pool = np.concatenate([np.frombuffer(b"".join(headers) + END, np.uint8), data])
    at = np.cumsum([0, *map(len, headers), len(END)])
    kind = np.array([kinds.index(x) for x in roles], np.int64)
    n = len(roles)
    source = np.empty((n, 3), np.int64)
    size = np.empty((n, 3), np.int64)
    source[:, 0], size[:, 0] = at[kind], np.diff(at)[kind]
    source[:, 1], size[:, 1] = at[-1] + offsets[:-1], np.diff(offsets)
    source[:, 2], size[:, 2] = at[-2], len(END)
    ends = np.cumsum(size.ravel())
    begins = ends - size.ravel()
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    np.take(pool, np.repeat(source.ravel() - begins, size.ravel()) + np.arange(len(out)), out=out)
    begins, ends = begins.reshape(n, 3), ends.reshape(n, 3)
    return out, np.append(begins[:, 0], len(out)), begins[:, 1], ends[:, 1]


def _segments(part: pa.RecordBatch, trained: tuple[str, ...]) -> tuple[list[int], pa.RecordBatch]:
    """First rows of the conversations in a batch (conv_id, role, text), and one row for each: conv_id, n_turns, formatted, loss_spans.

    The column ``formatted`` has the assembled array itself as its data buffer."""
    roles = part.column(1).to_pylist()
    out, at, begin, end = assembled(roles, *buffers(part.column(2)))
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    ids = part.column(0).to_pylist()
    first = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
    edges = np.array([*first, len(ids)])
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(at[edges].astype(np.int32)), pa.py_buffer(out))
    kept = np.flatnonzero([x in trained for x in roles])
    start = points[begin[kept]] - points[at[edges]][np.searchsorted(edges, kept, "right") - 1]
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(points[end[kept]] - points[begin[kept]])], ["start", "length"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, edges).astype(np.int32)), spans)
    return first, pa.RecordBatch.from_arrays([part.column(0).take(pa.array(first, pa.int64())), pa.array(np.diff(edges)), text, lists], names=["conv_id", "n_turns", "formatted", "loss_spans"])


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",), chunk_bytes: int = 8 * SLICE_BYTES) -> DataFrame:
    """conv_id, chunk, n_turns, formatted and loss_spans (start and length, in code points, of the contents of trained roles).

    A conversation is one row, chunk 0; one of over ``chunk_bytes`` is several, cut between turns, so that no task holds it whole."""
    base = small_batches(turns).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    key = base.schema["conv_id"].dataType.simpleString()

    def run(batches):
        held: list[pa.RecordBatch] = []  # turns of the last conversation, which may go on
        size, goes_on, chunk = 0, [], 0  # goes_on: the id of a conversation of which a chunk is out

        def made(part: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal goes_on, chunk
            first, rows = _segments(part, trained)
            number = np.zeros(len(first), np.int64)
            if goes_on and part.column(0)[0].as_py() == goes_on[0]:
                number[0] = chunk + 1
            goes_on, chunk = [part.column(0)[part.num_rows - 1].as_py()], int(number[-1])
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(number), *rows.columns[1:]], names=["conv_id", "chunk", "n_turns", "formatted", "loss_spans"])

        def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for batch in batches:
            for part in sliced(batch, 2):
                ids = part.column(0).to_pylist()
                border = next((k for k in range(len(ids) - 1, 0, -1) if ids[k] != ids[k - 1]), 0)
                if held and (border or ids[0] != held[-1].column(0)[0].as_py()):
                    yield made(joined([*held, *([part.slice(0, border)] if border else [])]))
                    held, size = [], 0
                elif border:
                    yield made(part.slice(0, border))
                held.append(part.slice(border))
                size += int(pc.sum(pc.binary_length(held[-1].column(2))).as_py())
                if size > chunk_bytes:
                    yield made(joined(held))
                    held, size = [], 0
        if held:
            yield made(joined(held))

    dealt = base.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {key}, chunk long, n_turns long, formatted string, loss_spans array<struct<start: long, length: long>>")


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    end, turn = END.decode(), TURN.decode()
    out = []
    for part in text.split(end)[:-1]:
        head, _, body = part.removeprefix(turn).partition("\n")
        out.append((role_of(head), unescaped(body)))
    return out


def read_back(conversations: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of formatted conversations, taken from the formatted text and its loss spans alone. Chunks stream by.

    in_order: rows come as ``formatted`` gives them; else they are dealt by id and sorted by chunk."""
    key = conversations.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches):
        now = None

        def rows(done: list[dict], like) -> pa.RecordBatch:
            ids = pa.concat_arrays([d["id"] for d in done]) if done else pa.array([], like)
            values = [(d["n"], d["turns"].hexdigest(), d["loss_n"], d["loss"].hexdigest(), d["chars"]) for d in done]
            return pa.RecordBatch.from_arrays([ids, *(pa.array([v[i] for v in values], t) for i, t in enumerate(kinds))], names=names)

        for batch in batches:
            for part in sliced(batch, 2):
                done = []
                for k, (chunk, text, spans) in enumerate(zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                    if chunk == 0 or now is None:
                        if now is not None:
                            done.append(now)
                        now = {"id": part.column(0).slice(k, 1), "n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0}
                    for role, body in parsed(text):
                        now["n"] += 1
                        now["turns"].update(f"{role}\n{body}\n".encode())
                    for s in spans:
                        body = unescaped(text[s["start"] : s["start"] + s["length"]])
                        now["loss_n"] += len(body)
                        now["loss"].update(body.encode())
                    now["chars"] += len(text)
                if done:
                    yield rows(done, part.column(0).type)
        if now is not None:
            yield rows([now], None)

    parts = conversations.select("conv_id", "chunk", "formatted", "loss_spans")
    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return parts.mapInArrow(run, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), made AS (
  SELECT *, '<|turn|>' || role || chr(10) || regexp_replace(text, '{CONTROL_SQL}', '\1\2\\\3', 'g') || '<|end|>' || chr(10) AS shown FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown)) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""
