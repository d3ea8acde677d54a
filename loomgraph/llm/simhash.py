"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within distance 2r have a common variant within distance r of both. So every distinct
fingerprint emits all variants within r = 2 (2,081 of them), variants meet by a shuffle, and whatever
meets is within 4 by the triangle inequality. No group has more than 2,081 fingerprints, since that many
lie within 2 of one variant: there is no hot key, whatever the data. Of a group only links to
its smallest member are kept, and each link only where its own middle is met, so that no pair comes twice.

Variants travel as packed arrays, about 10 bytes each, in several passes over disjoint parts of the variant space:
disk for one pass is 2,081 * 10 / passes bytes a distinct fingerprint. A pass builds its own variants only, since
the part of a variant is a linear function of its bits.

Defined results: null and wordless texts have fingerprint zero and are linked to each other (and to any
fingerprint within reach) like any other; equal texts have equal fingerprints; texts of any length are read whole; columns
other than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SLICE_BYTES, buffers, drop_shuffles, id_and_text, release, shared_dir, sliced, written
from loomgraph.llm.components import components
from loomgraph.llm.words import FIRST, U64, Words, _mixed

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BITS, HALF = 64, 2
#: Word fingerprints of ``one_of_each``: at a shingle similarity of 0.8 one lane in three links over 0.9 of the pairs.
LANES = 3
#: Variants that one task sorts at a time.
BUCKET_VARIANTS = 1 << 18
#: Variants of one pass, while 8 passes will do.
PASS_VARIANTS = 1 << 25
#: Fingerprints that are expanded at a time.
EXPANDED = 256

ONE = [1 << i for i in range(BITS)]
MASKS = np.array([0, *ONE, *(a | b for a, b in combinations(ONE, 2))], U64)


def shingle_hashes(words: Words, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all k-word shingles (words lower-cased and joined by one space), and the range of shingles of each text."""
    n = words.counts
    last = words.bounds[1:][n > 0] - 1
    between = np.ones(len(words), bool)
    between[last] = False
    kept = np.zeros(len(words.data) + 1, bool)
    kept[words.starts] = True
    kept[:-1] = np.cumsum(kept[:-1].astype(np.int8) - np.bincount(words.ends, minlength=len(kept))[: len(kept) - 1].astype(np.int8), dtype=np.int8) > 0
    gaps = words.ends[between]
    text = LOWER[words.data]
    text[gaps] = 32
    kept[gaps] = True
    size = words.ends - words.starts
    ends = np.cumsum(size + between)
    starts = (ends - size - between).tolist()
    ends = ends - between
    joined = text[kept[:-1]].tobytes()
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(words.bounds[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    final = ends[first + np.repeat(np.minimum(n, k), count) - 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[starts[i] : e], seed) for i, e in zip(first.tolist(), final, strict=True)), U64, len(first)), bounds


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, k: int = 4, seed: int = 42) -> np.ndarray:
    """A 64-bit SimHash of each text: a bit is set if it is set in over half of the shingle hashes."""
    hashes, bounds = shingle_hashes(Words(data, offsets), k, seed)
    count = np.diff(bounds)
    out = np.zeros(len(count), U64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, bounds[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > count[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) for every document. One scan, no shuffle."""
    base = id_and_text(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for part in sliced(batch, 1):
                found = fingerprints_of(*buffers(part.column(1)), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, fp long")


def _parity(x: np.ndarray, among: int) -> np.ndarray:
    return (np.bitwise_count(x & U64(among)) & 1).astype(np.int64)


def _part(x: np.ndarray, passes: int) -> np.ndarray:
    """Part of the variant space: parities of three or fewer fixed bit sets, so part(x ^ y) = part(x) ^ part(y)."""
    sets = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
    out = np.zeros(len(x), np.int64)
    for i in range(passes.bit_length() - 1):
        out |= _parity(x, sets[i]) << i
    return out


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    return ((x >> U64(33)) % U64(buckets)).astype(np.int32)


def _middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one variant at which the link of a < b is recorded."""
    differ = a ^ b
    count = np.bitwise_count(differ)
    low = differ & (~differ + U64(1))
    rest = differ ^ low
    return a ^ np.where(count >= 2, low, U64(0)) ^ np.where(count >= 4, rest & (~rest + U64(1)), U64(0))


def links_met(variants: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller, larger) among the fingerprints behind the variants of a bucket, verified to be within 4."""
    order = np.sort(variants)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return np.zeros(0, U64), np.zeros(0, U64)
    hit = again[np.minimum(np.searchsorted(again, variants), len(again) - 1)] == variants
    v = variants[hit]
    f = v ^ MASKS[masks[hit]]
    order = np.lexsort((f, v))
    v, f = v[order], f[order]
    first = np.concatenate(([True], v[1:] != v[:-1]))
    least = f[np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))]
    keep = (f != least) & (_middle(least, f) == v)
    least, f = least[keep], f[keep]
    near = np.bitwise_count(least ^ f) <= 2 * HALF
    return least[near], f[near]


def links(fps: DataFrame, path: str, passes: int | None = None) -> DataFrame:
    """(a, b): links that join all fingerprints within distance 4 of each other; fps: distinct longs in column fp.

    passes (1, 2, 4, 8 or 16; by default as many as PASS_VARIANTS asks for, 8 at most) trades disk for a few more small jobs; results don't depend on it."""
    spark = fps.sparkSession
    n = fps.count()
    passes = passes or next((p for p in (1, 2, 4) if n * len(MASKS) <= p * PASS_VARIANTS), 8)
    buckets = max(1, -(-n * len(MASKS) // (passes * BUCKET_VARIANTS)))
    groups = [np.flatnonzero(_part(MASKS, passes) == g).astype(np.uint16) for g in range(passes)]
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // (1 << 15)))
    spread = fps.repartition(tasks)

    def expand(this: int):
        def run(batches):
            for batch in batches:
                x = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
                for at in range(0, len(x), EXPANDED * passes):
                    some = x[at : at + EXPANDED * passes]
                    part = _part(some, passes)
                    v, m = [], []
                    for g in range(passes):
                        own = some[part == this ^ g]
                        v.append((own[:, None] ^ MASKS[groups[g]][None]).ravel())
                        m.append(np.tile(groups[g], len(own)))
                    v, m = np.concatenate(v), np.concatenate(m)
                    b = _bucket(v, buckets)
                    order = np.argsort(b.astype(np.uint16), kind="stable") if buckets <= 1 << 16 else np.argsort(b, kind="stable")
                    v, m, b = v[order], m[order], b[order]
                    edges = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
                    ends = np.append(edges[1:], len(b))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(b[edges]),
                        pa.array([v[i:j].tobytes() for i, j in zip(edges, ends, strict=True)], pa.binary()),
                        pa.array([m[i:j].tobytes() for i, j in zip(edges, ends, strict=True)], pa.binary()),
                    ], names=["bucket", "variants", "masks"])
            release()

        return run

    def meet(group: pa.Table) -> pa.Table:
        variants, masks = (np.frombuffer(b"".join(group[c].to_pylist()), t) for c, t in (("variants", U64), ("masks", np.uint16)))
        del group
        a, b = links_met(variants, masks)
        release()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    made = []
    for this in range(passes):
        packed = spread.mapInArrow(expand(this), "bucket int, variants binary, masks binary")
        made.append(written(packed.groupBy("bucket").applyInArrow(meet, "a long, b long"), path, f"links{this}"))
    out = made[0]
    for x in made[1:]:
        out = out.union(x)
    return out


def word_fingerprints(words: Words, lanes: int, seed: int) -> np.ndarray:
    """(texts, lanes): SimHashes of the set of lower-cased words of each text, each lane from other bits of a word's XXH64."""
    out = np.zeros((len(words.counts), lanes), U64)
    if not len(words):
        return out
    low = LOWER[words.data]
    key = FIRST.of_bytes(low, words.starts, words.ends)
    distinct, at, which = np.unique(key, return_index=True, return_inverse=True)
    order = np.unique(words.text.astype(np.int64) * len(distinct) + which)  # each word once a text
    text, word = np.divmod(order, len(distinct))
    raw, starts, ends = low.tobytes(), words.starts[at].tolist(), words.ends[at].tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(raw[i:j], seed) for i, j in zip(starts, ends, strict=True)), U64, len(at))
    count = np.bincount(text, minlength=len(out))
    some = np.flatnonzero(count)
    bounds = np.searchsorted(text, some)
    for k in range(lanes):
        bits = np.unpackbits(lane_of(hashes, k)[word].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, bounds, axis=0, dtype=np.int32)
        out[some, k] = np.packbits(2 * ones > count[some, None], axis=1).view(">u8").ravel()
    return out


def lane_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Independent 64 bits for each lane."""
    return _mixed(hashes + U64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1), 0xBF58476D1CE4E5B9)


def word_set_links(docs: DataFrame, path: str, id_col: str, text_col: str, shingle: int, seed: int, lanes: int, within: int, passes: int | None) -> DataFrame:
    """(a, b): links between shingle fingerprints of texts that have nearly the same words.

    An edited word changes ``shingle`` shingles but one word: texts that share four fifths of their shingles are 8 to 10 bits
    apart by shingles and about 4 by words, so ball hashing reaches them there, each lane about three of five. A link
    counts where the shingle fingerprints are within ``within`` bits, too; those of unrelated texts are about 32 apart."""
    base = id_and_text(docs, id_col, text_col)
    names = [f"w{k}" for k in range(lanes)]

    def run(batches):
        for batch in batches:
            for part in sliced(batch, 1, SLICE_BYTES // 2):
                data, offsets = buffers(part.column(1))
                own = word_fingerprints(Words(data, offsets), lanes, seed + 1)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (fingerprints_of(data, offsets, shingle, seed), *np.ascontiguousarray(own.T))], names=["fp", *names])

    kinds = ", ".join(f"{c} long" for c in ("fp", *names))
    prints = written(base.mapInArrow(run, kinds).distinct(), path, "prints")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= within
    out = None
    for c in names:
        one = written(prints.groupBy(F.col(c).alias("w")).agg(F.min("fp").alias("least")), f"{path}/{c}", "least")
        same = prints.select("fp", F.col(c).alias("w")).join(one, "w").filter((F.col("fp") != F.col("least")) & near("least", "fp")).select(F.col("least").alias("a"), F.col("fp").alias("b"))
        met = links(one.select(F.col("w").alias("fp")), f"{path}/{c}", passes)
        ends = met.join(one.select(F.col("w").alias("a"), F.col("least").alias("x")), "a").join(one.select(F.col("w").alias("b"), F.col("least").alias("y")), "b")
        across = ends.filter((F.col("x") != F.col("y")) & near("x", "y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
        both = same.union(across)
        out = both if out is None else out.union(both)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, passes: int | None = None, lanes: int = 0, within: int = 16) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id within reach over links of distance 4 or less.

    With lanes, so many fingerprints of the words of each text are linked as well (see ``word_set_links``)."""
    spark = docs.sparkSession
    drop_shuffles(spark)
    path = shared_dir(spark)
    all_fps = written(fingerprints(docs, id_col, text_col, shingle, seed), path, "fingerprints")
    distinct = written(all_fps.groupBy("fp").agg(F.min("doc_id").alias("least")), path, "distinct")
    edges = links(distinct.select("fp"), path, passes)
    if lanes:
        edges = edges.union(word_set_links(docs, f"{path}/words", id_col, text_col, shingle, seed, lanes, within, passes))
    found = components(edges, path)
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(member.join(least, "root").select("fp", "component_id"), path, "classes")
    return all_fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, lanes: int = LANES, **settings) -> DataFrame:
    """The documents with the smallest id of their component, with their columns as they are. Of rows that repeat an id, each stays.

    A row without an id stays where no document with an id is in its component; such rows are found again by their text."""
    found = near_duplicates(docs, id_col, text_col, shingle, lanes=lanes, **settings)
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    free = found.filter("doc_id IS NULL AND component_id IS NULL").select("fingerprint").distinct()
    without = docs.filter(F.col(id_col).isNull()).withColumn("__text", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    prints = fingerprints(without, "__text", text_col, shingle, settings.get("seed", 42)).select(F.col("doc_id").alias("__text"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))
    alone = prints.join(free, "fingerprint", "left_semi").select("__text").distinct()
    return docs.join(stay, id_col, "left_semi").select(*docs.columns).union(without.join(alone, "__text", "left_semi").select(*docs.columns))
