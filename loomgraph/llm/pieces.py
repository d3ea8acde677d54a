"""SentencePiece encoding and decoding of whole text columns in numpy.

Texts become code points; words are runs between spaces (the space leads the word, as in the model) and
around characters that no longer piece holds. Every distinct word of a slice is segmented once: words of equal
length advance together, one end position at a time; hashes of the substrings that end there probe the sorted
keys of the pieces, and a vectorised maximum over the candidates stores the backpointer.

For a unigram model the maximum is over summed piece scores. For a BPE model summed scores do not give the
model's own ids, so the candidates compete by whether merging would really leave them side by side: a
candidate may follow the best last piece of the shorter prefix only if undoing the merges of the two never
meets a merge across their border that would have come earlier. Exactly one candidate qualifies, and the ids are
those of merging by priority.

Words of over ``LONGEST`` characters, and words led by several spaces (whose pieces tie in priority), go
through a heap of merges instead, one by one.

Defined results: null and empty texts have no ids and decode to the empty string; a character outside the model
becomes byte pieces (the unknown id where the model has none); U+2581 in a text is a space to the model and decodes
to one; ids outside the model, control and null ids decode to nothing.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomgraph.llm.common import buffers, id_and_text, sliced
from loomgraph.llm.words import U64, _mixed

SPACE, MARK = 0x20, "▁"
LONGEST = 40
SLICE = 3 << 19
PIECE_BITS, PAIR_BITS = 21, 19
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6

BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)


def _values(points: np.ndarray) -> np.ndarray:
    x = points.astype(U64) * U64(0xD6E8FEB86659FD93)
    return (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9) | U64(1)


def _powers(of: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([U64(1)], np.full(n, of, U64))), dtype=U64)


class Index:
    """Values (from 0) of evenly spread 64-bit keys: the leading bits of a key tell where its run of the sorted keys begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int):
        order = np.argsort(keys)
        self.keys, self.values, self.shift = keys[order], np.asarray(values)[order].astype(np.int32), U64(64 - bits)
        slots = (self.keys >> self.shift).astype(np.int64)
        self.first = np.full(1 << bits, -1, np.int32)
        self.first[slots[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.run = int(np.bincount(slots).max()) if len(keys) else 0

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        out = np.full(len(asked), -1, np.int32)
        at = self.first[(asked >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(at >= 0)
        at, asked = at[todo], asked[todo]
        for _ in range(self.run):
            hit = self.keys[at] == asked
            out[todo[hit]] = self.values[at[hit]]
            more = np.flatnonzero(~hit & (at < len(self.keys) - 1))
            if not len(more):
                break
            todo, asked, at = todo[more], asked[more], at[more] + 1
        return out


@dataclass
class Model:
    """Pieces of a SentencePiece model as arrays; built on the driver and sent to tasks (a few MB for 32,000 pieces)."""

    kind: str
    ids_of: Index
    score: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rank_of_pair: Index
    joined: np.ndarray
    byte_id: np.ndarray
    unknown: int
    longest: int
    pool: np.ndarray
    pool_at: np.ndarray
    by_text: dict
    prefix: bool

    @staticmethod
    def read(path: str) -> Model:
        """From a .model file on the driver."""
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation and leading spaces are supported")
        kind = {1: "unigram", 2: "bpe"}.get(proto.trainer_spec.model_type)
        if kind is None:
            raise ValueError("only unigram and BPE models are supported")
        return Model.of([(p.piece, p.score, p.type) for p in proto.pieces], kind, proto.normalizer_spec.add_dummy_prefix)

    @staticmethod
    def of(pieces: list[tuple[str, float, int]], kind: str, prefix: bool = True) -> Model:
        n = len(pieces)
        text = [p.replace(MARK, " ") for p, _, _ in pieces]
        by_text = {text[i]: i for i in range(n) if pieces[i][2] in (NORMAL, USER)}
        score = np.array([s for _, s, _ in pieces], np.float64)
        rank, left, right = np.full(n, -1, np.int32), np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        usable = dict(by_text)
        if kind == "bpe":
            single = [i for t, i in by_text.items() if len(t) == 1]
            merged = sorted((i for t, i in by_text.items() if len(t) > 1), key=lambda i: (-score[i], i))
            rank[single] = np.arange(len(single))
            rank[merged] = len(single) + np.arange(len(merged))
            for i in merged:
                parts = merge(text[i], by_text, score, stop=2)
                if len(parts) == 2 and parts[0] + parts[1] == text[i] and parts[0] in by_text and parts[1] in by_text:
                    left[i], right[i] = by_text[parts[0]], by_text[parts[1]]
                else:
                    del usable[text[i]]
        made = [i for i in usable.values() if left[i] != right[i] or len(text[i]) > 1]
        made = [i for i in made if kind == "bpe" and len(text[i]) > 1]
        pairs = left[made].astype(np.int64) * n + right[made] if made else np.zeros(0, np.int64)
        points = [np.array([ord(c) for c in t], np.uint32) for t in usable]
        keys = np.array([_key(p) for p in points], U64) if points else np.zeros(0, U64)
        joined = np.unique(np.array([ord(c) for t in by_text if len(t) > 1 for c in t], np.uint32))
        byte_id = np.full(256, -1, np.int64)
        for i, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                byte_id[int(p[3:5], 16)] = i
        unknown = next((i for i in range(n) if pieces[i][2] == UNKNOWN), 0)
        shown = [bytes([int(p[3:5], 16)]) if t == BYTE else text[i].encode() if t in (NORMAL, USER) else b" \xe2\x81\x87 " if t == UNKNOWN else b"" for i, (p, _, t) in enumerate(pieces)]
        shown.append(b"")  # for ids outside the model
        return Model(
            kind, Index(keys, list(usable.values()), PIECE_BITS), score, rank, left, right,
            Index(pairs.astype(U64) * U64(BASE), rank[made], PAIR_BITS), joined, byte_id, unknown, max(map(len, usable), default=1),
            np.frombuffer(b"".join(shown), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in shown]))), by_text, prefix,
        )

    # -- probing -------------------------------------------------------------------------------------------

    def stand_together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Would merging leave a and b as neighbours? Undo the later merge of the two, again and again."""
        n, big = len(self.rank), np.iinfo(np.int32).max
        out = np.zeros(len(a), bool)
        todo = np.arange(len(a))
        a, b, limit = a.astype(np.int32), b.astype(np.int32), np.full(len(a), big, np.int32)
        while len(todo):
            whole = self.rank_of_pair((a.astype(np.int64) * n + b).astype(U64) * U64(BASE))
            over = (whole >= 0) & (whole < limit)
            rank_a, rank_b = self.rank[a], self.rank[b]
            later_a = rank_a > rank_b
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            done = whole_a & whole_b
            split_a = ~over & ~done & (later_a & ~whole_a | whole_b)
            split_b = ~over & ~done & ~split_a
            out[todo[~over & done]] = True
            go = np.flatnonzero(split_a | split_b)  # most are settled at once
            first, a, b = split_a[go], a[go], b[go]
            limit = np.where(first, rank_a[go], rank_b[go] + 1)
            todo, a, b = todo[go], np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    # -- segmentation --------------------------------------------------------------------------------------

    def segment(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """points: (m, L) code points of m words of equal length. All ids end to end, and the number of ids of each word.

        A position that no piece reaches is an unknown character, written as -1 - code point."""
        m, size = points.shape
        up, down = _powers(BASE, size), _powers(INVERSE, size)
        prefix = np.zeros((m, size + 1), U64)
        np.cumsum(_values(points) * up[None, :size], axis=1, dtype=U64, out=prefix[:, 1:])
        best = np.zeros((m, size + 1))
        last = np.full((m, size + 1), -1, np.int32)  # piece that ends here in the best segmentation
        back = np.zeros((m, size + 1), np.int64)
        for end in range(1, size + 1):
            widths = np.arange(1, min(end, self.longest) + 1)
            keys = np.stack([_mixed((prefix[:, end] - prefix[:, end - w]) * down[end - w] + U64(w), BASE) for w in widths], axis=1)
            ids = self.ids_of(keys.ravel()).reshape(m, len(widths))
            row, col = np.nonzero(ids >= 0)
            start, piece = end - widths[col], ids[row, col]
            if self.kind == "unigram":
                value = np.full((m, len(widths)), -np.inf)
                value[row, col] = best[row, start] + self.score[piece]
                pick = np.argmax(value, axis=1)
                top = value[np.arange(m), pick]
                found = np.isfinite(top)
                best[:, end] = np.where(found, top, best[:, end - 1] - 1e6)
            else:
                pick, before = np.full(m, -1), last[row, start]
                longest = np.ones(len(row), bool)
                longest[:-1] = row[1:] != row[:-1]
                # The longest candidate that fits; the shorter ones are only asked where the longest doesn't.
                for asked in (lambda: np.flatnonzero(longest), lambda: np.flatnonzero(~longest & (pick[row] < 0))):
                    some = asked()
                    fits = (start[some] == 0) | (before[some] < 0)
                    others = np.flatnonzero(~fits)
                    fits[others] = self.stand_together(before[some[others]], piece[some[others]])
                    pick[row[some[fits]]] = col[some[fits]]
                found = pick >= 0
            back[:, end] = np.where(found, widths[pick], 1)
            last[:, end] = np.where(found, ids[np.arange(m), pick], -1)
        rows, at, out = np.arange(m), np.full(m, size), []
        while len(rows):
            piece = last[rows, at]
            out.append((rows, at, np.where(piece >= 0, piece, -1 - points[rows, at - 1].astype(np.int32))))
            at = at - back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        row, place, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((place, row))
        return piece[order], np.bincount(row, minlength=m)

    def _bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as byte pieces."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, counts
        raw = [chr(-1 - i).encode("utf-8", "replace") for i in ids[odd].tolist()]
        if (self.byte_id < 0).any():
            raw_ids = [[self.unknown] for _ in raw]
        else:
            raw_ids = [self.byte_id[list(x)].tolist() for x in raw]
        width = np.ones(len(ids), np.int64)
        width[odd] = [len(x) for x in raw_ids]
        ends = np.cumsum(width)
        out = np.repeat(ids, width)
        for k, x in zip(odd.tolist(), raw_ids, strict=True):
            out[ends[k] - width[k] : ends[k]] = x
        word_ends = np.cumsum(counts)
        upto = np.concatenate(([0], ends))[np.concatenate(([0], word_ends))]
        return out, np.diff(upto)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of the texts."""
        lead = " " if self.prefix else ""
        whole = "".join([lead + t if t else "" for t in texts])
        points = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(t) + len(lead) if t else 0 for t in texts]))).astype(np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        points = np.where(points == ord(MARK), np.uint32(SPACE), points)
        gap = points == SPACE
        table = np.zeros(0x110000, bool)
        table[self.joined] = True
        alone = ~table[points]
        start = np.zeros(len(points), bool)
        start[offsets[:-1][offsets[:-1] < len(points)]] = True
        start[1:] |= gap[1:] & ~gap[:-1] | alone[1:] | alone[:-1]
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(points))
        size = ends - starts
        # One array as long as the slice after the other: few at a time.
        values = _values(points)
        values *= _powers(BASE, len(points))[:-1]
        prefix = np.zeros(len(points) + 1, U64)
        np.cumsum(values, dtype=U64, out=prefix[1:])
        del values
        between = prefix[ends] - prefix[starts]
        del prefix
        keys = _mixed(between * _powers(INVERSE, len(points))[starts] + size.astype(U64), BASE)
        del between, start, alone
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        first, length = starts[one], size[one]
        several = (length > 1) & gap[first] & gap[np.minimum(first + 1, len(gap) - 1)]
        slow = (several | (length > LONGEST)) if self.kind == "bpe" else length > 4096
        parts, order = [], []
        for n in np.unique(length[~slow]).tolist():
            group = np.flatnonzero((length == n) & ~slow)
            for at in range(0, len(group), 20_000):
                own = group[at : at + 20_000]
                parts.append(self._bytes(*self.segment(points[first[own][:, None] + np.arange(n)])))
                order.append(own)
        for k in np.flatnonzero(slow).tolist():
            word = points[first[k] : first[k] + length[k]]
            ids = self._merged(word) if self.kind == "bpe" else self._bytes(*self.segment(word[None]))[0]
            parts.append((ids, np.array([len(ids)])))
            order.append(np.array([k]))
        pool = np.concatenate([p[0] for p in parts])
        order = np.concatenate(order)
        counts, at = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        made = np.concatenate([p[1] for p in parts])
        counts[order], at[order] = made, np.cumsum(made) - made
        n_ids = counts[which]
        upto = np.concatenate(([0], np.cumsum(n_ids)))
        out = pool[np.repeat(at[which] - upto[:-1], n_ids) + np.arange(upto[-1])]
        return out.astype(np.int32), upto[np.searchsorted(starts, offsets)]

    def _merged(self, word: np.ndarray) -> np.ndarray:
        parts = merge("".join(map(chr, word.tolist())), self.by_text, self.score)
        ids = np.array([self.by_text.get(p, -1 - ord(p[0])) for p in parts], np.int64)
        return self._bytes(ids, np.ones(len(ids), np.int64))[0]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists: piece bytes are gathered into one buffer."""
        n = len(self.pool_at) - 2
        ids = np.where((ids >= 0) & (ids < n), ids, n).astype(np.int64)
        size = np.diff(self.pool_at)[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        whole = self.pool[np.repeat(self.pool_at[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        bounds = upto[offsets].tolist()
        out = [whole[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in out]


def _key(points: np.ndarray) -> int:
    n = len(points)
    return int(_mixed(np.array([(_values(points) * _powers(BASE, n)[:n]).sum(dtype=U64) + U64(n)]), BASE)[0])


def merge(text: str, by_text: dict, score: np.ndarray, stop: int = 1) -> list[str]:
    """Parts of a text after merging neighbours by priority (ties: leftmost), until stop parts are left."""
    parts, n = list(text), len(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (k := by_text.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-score[k], i, parts[i], parts[j]))

    for i in range(n - 1):
        offer(i)
    left = n
    while heap and left > stop:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] == a else n
        if j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        left -= 1
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p is not None]


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ids array<int> of every document. One scan, no shuffle."""
    base = id_and_text(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                ids, offsets = sent.value.encode([str(x, "utf-8", "replace") for x in part.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["doc_id", "text", "ids"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>")


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids") -> DataFrame:
    """encoded with a column ``decoded``: the text of the ids. Null lists decode to the empty string."""
    rest = [x for x in encoded.columns if x != "decoded"]
    at = rest.index(ids_col)
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = part.column(at)
                flat, sizes = lists.flatten(), np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
                texts = sent.value.decode(pc.fill_null(flat, -1).to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*rest, "decoded"])

    return encoded.select(*rest).mapInArrow(run, encoded.select(*rest).schema.add("decoded", "string"))


def encoded_and_decoded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode and decode in one pass: doc_id, text, ids and decoded. The ids are decoded by the task that made them, in one Python worker."""
    base = id_and_text(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                ids, offsets = sent.value.encode([str(x, "utf-8", "replace") for x in part.column(1).cast(pa.binary()).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                # Read back from the column, as a reader of it would.
                texts = sent.value.decode(lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(texts, pa.string())], names=["doc_id", "text", "ids", "decoded"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>, decoded string")
