"""Substring dedup with repeated-phrase automata: words of passages of 50 or more words that an earlier document has, go.

1. Sketch. Of every window of 50 words the 8-word gram with the smallest hash is its anchor (rightmost of
   ties). Equal windows have equal anchors at equal places, so nothing that recurs is missed, and there is about one
   anchor in 22 words. Of documents with equal word sequences only the first is searched; the others go whole.
2. Recurring anchors are those of two or more documents (one aggregation). Around each of their places, the
   words of the windows that the anchor stands for are cut out as a segment.
3. Confirmation. Window hashes of distinct segments are aggregated: a window is confirmed if two
   documents have it, and its first document is kept.
4. Automata. The phrases of anchors of confirmed windows (all phrases, should two have one hash) are dealt over shards, as
   many as phrases ask for; every shard compiles its phrases with pyahocorasick and streams what was dealt to it: the
   words around every recurring anchor of every document. Each occurrence of a phrase is found as text; the windows
   around it that are confirmed and start in an earlier document mark their words.

A document is streamed as the neighbourhoods of its recurring anchors, not whole: a window that another document has holds
such an anchor, so nothing else can match, and every word passes a bounded number of shards. Whole documents past every
shard would cost shards times corpus, which grows with the square of the input.

Phrases of frequent anchors are copied to as many salts as their segments need, so that no shard gets all
segments of a common passage; a shard holds phrases and confirmed windows only, segments stream by. Keys are
two independent 64-bit hashes (anchor and window), and phrases are compared as text.

Defined results: null and wordless texts have no words; texts under 50 words lose none; windows are judged on the
input; a window that repeats only within its document stays; doc_id is the key, and rows that repeat one must
have equal texts. Texts of any length are searched whole; other columns keep their values, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import buffers, drop_shuffles, free_name, id_and_text, shared_dir, sliced, written
from loomgraph.llm.words import FIRST, SECOND, U64, Words, covered

WINDOW, GRAM = 50, 8
#: Segments of one anchor that one salt takes.
SEGMENTS_A_SALT = 256
#: Phrases that one shard's automaton holds, about.
PHRASES_A_SHARD = 50_000


def joined_words(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words, each followed by one space, as bytes; start and end of each word in them."""
    size = words.ends - words.starts
    ends = np.cumsum(size + 1) - 1
    out = np.full(len(words) and int(ends[-1]) + 1, 32, np.uint8)
    starts = ends - size
    index = np.repeat(words.starts - starts, size) + np.delete(np.arange(len(out)), ends)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = words.data[index]
    return out.tobytes(), starts, ends


def anchors(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each window start, the place of its smallest gram hash (rightmost of ties)."""
    n = WINDOW - GRAM + 1
    pick, width = np.arange(len(grams)), 1
    while 2 * width <= n:
        other = pick[np.minimum(np.arange(len(pick)) + width, len(pick) - 1)]
        pick = np.where(grams[other] <= grams[pick], other, pick)
        width *= 2
    other = pick[starts + n - width]
    pick = pick[starts]
    return np.where(grams[other] <= grams[pick], other, pick)


def _anchored(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all texts of 50 words or more: anchor hash, its text, and place, first and last window start within the text."""
    starts = words.windows(WINDOW)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    at = np.arange(max(len(words) - GRAM + 1, 0))
    grams = FIRST.of_words(hashes, at, at + GRAM)
    owner = anchors(grams, starts)
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (words.text[starts[1:]] != words.text[starts[:-1]]))))
    last = np.append(first[1:], len(starts)) - 1
    place, text = owner[first], words.text[starts[first]]
    base = words.bounds[text]
    return grams[place].view(np.int64), text, place - base, starts[first] - base, starts[last] - base


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, k1 and k2 (128 bits of the word sequence), sha256 of the words, and anchors. One scan, no shuffle."""
    base = id_and_text(docs, id_col, text_col)
    kind = pa.struct([("h", pa.int64()), ("place", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in sliced(batch, 1):
                words = Words(*buffers(part.column(1)))
                hashes = words.hashes(FIRST)
                h, text, place, lo, hi = _anchored(words, hashes)
                text_out, starts, ends = joined_words(words)
                a, b = words.bounds[:-1], words.bounds[1:]
                shas = [hashlib.sha256(text_out[starts[i] : ends[j - 1]] if j > i else b"").hexdigest() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                lists = pa.StructArray.from_arrays([pa.array(h), *(pa.array(x.astype(np.int32)) for x in (place, lo, hi))], fields=list(kind))
                upto = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(words.counts), pa.array(FIRST.of_words(hashes, a, b).view(np.int64)),
                    pa.array(SECOND.of_words(words.hashes(SECOND), a, b).view(np.int64)), pa.array(shas), pa.ListArray.from_arrays(pa.array(upto), lists),
                ], names=["doc_id", "n_words", "k1", "k2", "sha256", "anchors"])

    key = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {key}, n_words long, k1 long, k2 long, sha256 string, anchors array<struct<h: long, place: int, lo: int, hi: int>>")


def segments(texts: DataFrame) -> DataFrame:
    """texts: doc_id, text and found (anchors with their count n). A row for each: the words of its windows, their hashes, the phrase."""
    key = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in sliced(batch, 1):
                words = Words(*buffers(part.column(1)))
                found = part.column(2)
                row = pc.list_parent_indices(found).to_numpy(zero_copy_only=False)
                h, place, lo, hi, n = (x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten())
                base = words.bounds[row]
                out, starts, ends = joined_words(words)
                second = words.hashes(SECOND)
                count = hi - lo + 1
                at = np.repeat(base + lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
                windows = SECOND.of_words(second, at, at + WINDOW).view(np.int64)
                whole = FIRST.of_words(second, base + lo, base + hi + WINDOW).view(np.int64)
                a, b = starts[base + lo], ends[base + hi + WINDOW - 1]
                p, q = starts[base + place], ends[base + place + GRAM - 1]
                cut = lambda x, y: pa.array([out[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)], pa.binary()).cast(pa.string())
                upto = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h), pa.array(n), part.column(0).take(pa.array(row)), pa.array(lo), cut(a, b), cut(p, q), pa.array(whole),
                    pa.ListArray.from_arrays(pa.array(upto), pa.array(windows)),
                ], names=["h", "n", "doc_id", "lo", "words", "phrase", "whole", "windows"])

    return texts.select("doc_id", "text", "found").mapInArrow(run, f"h long, n long, doc_id {key}, lo int, words string, phrase string, whole long, windows array<long>")


class Shard:
    """The phrases and confirmed windows of one shard, and the automaton over its phrases."""

    def __init__(self):
        self.phrases: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.automaton = None

    def compiled(self) -> Shard:
        self.automaton = ahocorasick.Automaton()
        for phrase, h in self.phrases.items():
            # Spaces on both sides: whole words only.
            self.automaton.add_word(f" {phrase} ", (h, len(phrase) + 2))
        if self.phrases:
            self.automaton.make_automaton()
        h, w, first = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else (np.zeros(0, np.int64),) * 3
        self.keys = self._key(h, w)
        order = np.argsort(self.keys)
        self.keys, self.h, self.w, self.first = self.keys[order], h[order], w[order], first[order]
        self.phrases, self.rows = {}, []
        return self

    @staticmethod
    def _key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (h.view(U64) * U64(FIRST.multiplier)) ^ w.view(U64)

    def first_document(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a window is confirmed under an anchor, and its first document."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        ask = self._key(h, w)
        hit = np.minimum(np.searchsorted(self.keys, ask), len(self.keys) - 1)
        good = (self.keys[hit] == ask) & (self.h[hit] == h) & (self.w[hit] == w)
        return good, self.first[hit]

    def spans(self, doc: np.ndarray, lo: np.ndarray, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments in, (document, first word, word after the last) of repeated passages out."""
        words = Words(*buffers(text))
        hits_row, hits_h, hits_at = [], [], []
        if len(self.h) and len(self.automaton):
            for row, segment in enumerate(text.to_pylist()):
                for end, (h, size) in self.automaton.iter(f" {segment} "):
                    hits_row.append(row)
                    hits_h.append(h)
                    hits_at.append(segment.count(" ", 0, end + 1 - size))
        none = np.zeros(0, np.int64)
        if not hits_row:
            return none, none, none
        row, h, at = np.array(hits_row), np.array(hits_h, np.int64), np.array(hits_at)
        # All windows of the segment that hold the phrase.
        n = words.counts[row]
        first, last = np.maximum(at + GRAM - WINDOW, 0), np.minimum(at, n - WINDOW)
        count = np.maximum(last - first + 1, 0)
        which = np.repeat(np.arange(len(row)), count)
        start = first[which] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = words.bounds[row[which]] + start
        w = SECOND.of_words(words.hashes(SECOND), place, place + WINDOW).view(np.int64)
        good, origin = self.first_document(h[which], w)
        good &= origin < doc[row[which]]
        d, s = doc[row[which]][good], (lo[row[which]] + start)[good]
        if not len(d):
            return none, none, none
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)))
        tail = np.concatenate((np.flatnonzero(new)[1:], [len(s)])) - 1
        return d[new], s[new], s[tail] + WINDOW


def located(confirmed: DataFrame, phrases: DataFrame, segs: DataFrame) -> DataFrame:
    """(doc_id, a, b): word ranges of repeated passages. Phrases and windows reach a shard first, segments stream after them."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / SEGMENTS_A_SALT)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    counts = phrases.select("h", salts.alias("salts"))
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    rows = (
        phrases.select("h", salts.alias("salts"), F.explode("phrases").alias("phrase")).select("h", every.alias("salt"), F.lit(0).alias("kind"), none("long").alias("v"), none("long").alias("doc"), none("int").alias("lo"), F.col("phrase").alias("words"))
        .union(confirmed.join(counts, "h").select("h", every, F.lit(1), "w", "first", none("int"), none("string")))
        .union(segs.select("h", F.pmod(F.xxhash64("doc_id"), salts).cast("int"), F.lit(2), none("long"), "doc_id", "lo", "words"))
    )

    def run(batches):
        shard = Shard()
        for batch in batches:
            for part in sliced(batch, 5, 1 << 20):
                h, kind, v, doc, lo = (pc.fill_null(part.column(i), 0).to_numpy(zero_copy_only=False) for i in range(5))
                if (own := kind == 0).any():
                    shard.phrases.update(zip(part.column(5).filter(pa.array(own)).to_pylist(), h[own].tolist(), strict=True))
                if (own := kind == 1).any():
                    shard.rows.append((h[own], v[own], doc[own]))
                if (own := kind == 2).any():
                    shard = shard if shard.automaton is not None else shard.compiled()
                    d, a, b = shard.spans(doc[own], lo[own].astype(np.int64), part.column(5).filter(pa.array(own)))
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], names=["doc_id", "a", "b"])

    # More shards than Spark's setting only where phrases ask for them.
    total = phrases.agg(F.sum(salts)).first()[0] or 0
    shards = max(int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PHRASES_A_SHARD))
    dealt = rows.repartition(shards, "h", "salt").sortWithinPartitions("kind").select("h", "kind", "v", "doc", "lo", "words")
    return dealt.mapInArrow(run, "doc_id long, a long, b long")


class Repeats:
    """What substring dedup finds in documents: sketches, whole copies and word ranges, as tables in the shared folder.

    The id column must be an integer."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        drop_shuffles(spark)
        path = shared_dir(spark)
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
        self.sketch = written(sketch(self.texts), path, "sketch")
        long_ones = self.sketch.filter(F.col("n_words") >= WINDOW)
        self.firsts = written(long_ones.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), path, "firsts")
        held = long_ones.join(self.firsts, "doc_id", "left_semi").select("doc_id", F.inline("anchors"))
        recurring = held.groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("n")).filter("x < y").select("h", "n")
        # Written, so that the join that follows is between two plain tables and Spark can split its hot keys.
        recurring = written(recurring, path, "recurring")
        found = held.join(recurring, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "place", "lo", "hi", "n")).alias("found"))
        segs = written(segments(self.texts.join(found, "doc_id")), path, "segments")
        distinct = segs.groupBy("h", "whole").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.any_value("windows").alias("windows"))
        windows = distinct.select("h", "x", "y", F.explode("windows").alias("w"))
        confirmed = windows.groupBy("h", "w").agg(F.min("x").alias("first"), F.max("y").alias("last")).filter("first < last").select("h", "w", "first")
        confirmed = written(confirmed, path, "confirmed")
        used = written(confirmed.select("h").distinct(), path, "used")
        phrases = segs.groupBy("h").agg(F.collect_set("phrase").alias("phrases"), F.max("n").alias("n")).join(used, "h", "left_semi")
        ranges = located(confirmed, written(phrases, path, "phrases"), segs.join(used, "h", "left_semi"))
        self.ranges = written(ranges, path, "ranges")
        self.by_document = self.ranges.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))

    def _cut(self, df: DataFrame, schema, make) -> DataFrame:
        """make(part, words, removed flags of words) for slices of (text, ranges, ...)."""

        def run(batches):
            for batch in batches:
                for part in sliced(batch, 0):
                    words = Words(*buffers(part.column(0)))
                    row = pc.list_parent_indices(part.column(1)).to_numpy(zero_copy_only=False)
                    a, b = (x.to_numpy(zero_copy_only=False) for x in part.column(1).flatten().flatten())
                    yield make(part, words, covered(words.bounds[row] + a, words.bounds[row] + b, len(words)))

        return df.mapInArrow(run, schema)

    def report(self) -> DataFrame:
        """doc_id, n_words, n_removed and kept_sha256 of every document."""

        def make(part, words, gone):
            left = ~gone
            kept = kept_texts(words, left)
            removed = words.counts - np.array([x[1] for x in kept], np.int64)
            return pa.RecordBatch.from_arrays([part.column(2), pa.array(removed), pa.array([hashlib.sha256(x[0]).hexdigest() for x in kept])], names=["doc_id", "n_removed", "kept_sha256"])

        changed = self._cut(self.texts.join(self.by_document, "doc_id").select("text", "ranges", "doc_id"), "doc_id long, n_removed long, kept_sha256 string", make).dropDuplicates(["doc_id"])
        base = self.sketch.select("doc_id", "n_words", "sha256").join(self.firsts.withColumn("first", F.lit(True)), "doc_id", "left")
        copy = (F.col("n_words") >= WINDOW) & F.col("first").isNull() & F.col("doc_id").isNotNull()
        return base.join(changed, "doc_id", "left").select(
            "doc_id", "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        )

    def documents(self) -> DataFrame:
        """The documents without repeated passages: changed texts are the words that stay, joined by one space;
        unchanged texts stay as they are; documents of which no word stays go. n_chars, where there is one, follows."""
        names, text_col = self.docs.columns, self.text_col
        own, found, old_text, new_text = (free_name(x, names) for x in ("own_id", "own_ranges", "old_text", "new_text"))
        whole = self.sketch.filter(F.col("n_words") >= WINDOW).select("doc_id").join(self.firsts, "doc_id", "left_anti").select(F.col("doc_id").alias(own)).distinct()
        left = self.docs.withColumn(own, F.col(self.id_col).cast("long")).join(whole, own, "left_anti")
        left = left.join(self.by_document.select(F.col("doc_id").alias(own), F.col("ranges").alias(found)), own, "left")
        same = left.filter(F.col(found).isNull()).select(*(F.col(f"`{c}`") for c in names))

        def make(part, words, gone):
            kept = kept_texts(words, ~gone)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.binary()).cast(pa.string()), *part.columns[2:]], names=[new_text, *names])

        schema = T.StructType([T.StructField(new_text, T.StringType()), *self.docs.schema.fields])
        changed = left.filter(F.col(found).isNotNull()).select(F.col(f"`{text_col}`").alias(old_text), F.col(found), *(F.col(f"`{c}`") for c in names))
        cut = self._cut(changed, schema, make).filter(F.col(new_text) != "")
        new = {text_col: F.col(new_text), **({"n_chars": F.length(new_text).cast(self.docs.schema["n_chars"].dataType)} if "n_chars" in names else {})}
        return same.union(cut.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in names)))


def kept_texts(words: Words, left: np.ndarray) -> list[tuple[bytes, int]]:
    """For each text: its words with a flag, joined by one space, and their number."""
    out, starts, ends = joined_words(words)
    mask = np.repeat(left, ends - starts + 1) if len(words) else np.zeros(0, bool)
    kept = np.frombuffer(out, np.uint8)[mask].tobytes()
    size = np.concatenate(([0], np.cumsum(np.where(left, ends - starts + 1, 0))))
    n = np.concatenate(([0], np.cumsum(left)))
    bounds = words.bounds.tolist()
    return [(kept[size[i] : size[j] - 1] if n[j] > n[i] else b"", int(n[j] - n[i])) for i, j in zip(bounds, bounds[1:], strict=False)]
