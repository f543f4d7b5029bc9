"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A signature has CHUNKS x CHUNK minima of BITS bits. By pigeonhole, two
signatures that differ in fewer than CHUNKS * (ERRORS + 1) places have a chunk
with at most ERRORS differing places; every document is filed under each chunk
with each choice of ERRORS places left open, so every pair under that distance
shares a key. Candidates are confirmed on the full shingle sets.

Groups are not expanded into pairs. Equal shingle sets are one class. A bucket's
members are first compared with its smallest member, its hub; what the
confirmed links join is one component. Only hubs whose members are still in
several components are searched pair by pair, in blocks, for pairs between
components, by the distance of the signatures and then by sketches that hold
the whole set of most documents; no more than the few likely pairs leave a block.

Null and empty texts: an empty set, linked with nothing. Null ids: kept, linked
with nothing, no component. Repeated rows are documents with equal sets; of
different texts under one id each has its own set size, and the one with the
least hash stands for the id in links. Ties: the smallest id names a component.
Very long texts are hashed whole. Other columns are not read, so their names
can't clash. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, by_group, cut, forget, ship, stars, table

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
#: 8 chunks of 5 minima with one open place: all pairs that differ in at most 15 of 40 places share a key.
#: A pair at a similarity of 0.75 shares one with a probability above 0.9996.
CHUNKS, CHUNK, ERRORS, BITS = 8, 5, 1, 16
#: The distance threshold of the join: pairs whose signatures differ in more places are not confirmed (at a similarity
#: of 0.75 a pair is that far apart with a probability below 2 in 1,000,000).
FARTHEST = 24
#: Members of a hub that are compared at once.
BLOCK = 512
#: A sketch is the SKETCH smallest 32-bit shingle hashes: the whole set up to that size. A pair is confirmed on full sets
#: unless its sketches put it this far below the threshold: EDGE, and SIGMAS standard deviations if a sketch is cut.
SKETCH, EDGE, SIGMAS = 512, 0.01, 4.5
#: Bytes of text that are hashed together.
SLICE_BYTES = 4_000_000
SEED = 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray, doc_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts that ``raw`` holds one after another, and how many words each text has.

    Words are the runs of bytes other than space and 0x09 to 0x0D, A-Z lowered.
    """
    n = len(raw)
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    inside = ~((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)))
    cut_at = np.zeros(n + 1, bool)
    cut_at[doc_end[doc_end < n]] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | cut_at[:n]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | cut_at[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(doc_end), np.int64)
    # a polynomial of the bytes of each word, counted from its first byte
    flat = np.arange(n)
    flat[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, n)))
    size = ends - starts
    power = _powers(int(size.max()) + 1)
    value = np.zeros(n, np.uint64)
    at = np.flatnonzero(inside)
    value[at] = _BYTES[low[at]] * power[flat[at]]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    h = _mix(total[ends] - total[starts] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bounds = np.searchsorted(starts, doc_end)
    return h, np.diff(np.concatenate(([0], bounds)))


def shingle_sets(raw: np.ndarray, doc_end: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after another, and their numbers."""
    words, counts = word_hashes(raw, doc_end)
    first = np.cumsum(counts) - counts
    n_sh = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), n_sh)
    at = np.repeat(first - (np.cumsum(n_sh) - n_sh), n_sh) + np.arange(int(n_sh.sum()))
    left = np.repeat(counts, n_sh)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        use = left > j
        w = words[np.minimum(at + j, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
        h = np.where(use, _mix(h * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(j + 1)), h)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(counts) <= 65_536 else np.int64), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(counts))


def signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """CHUNKS * CHUNK minima of each set, BITS bits each; sets must not be empty."""
    rng = np.random.default_rng(SEED)
    places = CHUNKS * CHUNK
    mul = rng.integers(1, 2**63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, places, dtype=np.uint64)
    begin = np.cumsum(counts) - counts
    out = np.empty((len(counts), places), np.uint16)
    for i in range(places):
        low = np.minimum.reduceat(h * mul[i] + add[i], begin)
        out[:, i] = (_mix(low) >> np.uint64(64 - BITS)).astype(np.uint16)
    return out


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column as (from, to, bytes, where each text ends)."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        b = min(b, len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]
        a = b


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, s1, s2, sig): two sums over mixed shingles name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, ends in texts_of(batch.column(1)):
                h, counts = shingle_sets(raw, ends)
                some = counts > 0
                s1, s2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                sig: list[bytes | None] = [None] * (b - a)
                if some.any():
                    begin = (np.cumsum(counts) - counts)[some]
                    s1[some] = np.add.reduceat(_mix(h + np.uint64(1)), begin)
                    s2[some] = np.add.reduceat(_mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
                    for i, row in zip(np.flatnonzero(some).tolist(), signatures(h, counts[some])):
                        sig[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sig, pa.binary())],
                    ["id", "n_shingles", "s1", "s2", "sig"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n_shingles long, s1 long, s2 long, sig binary")


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature, a key for every chunk and every choice of an open place in it."""
    n = len(sig)
    parts = sig.reshape(n, CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((n, CHUNKS * CHUNK), np.uint64)
    for c in range(CHUNKS):
        for hole in range(CHUNK):
            key = np.full(n, c * CHUNK + hole + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for j in range(CHUNK):
                if j != hole:
                    key = _mix(key + parts[:, c, j] + np.uint64(j << 20))
            out[:, c * CHUNK + hole] = key
    return out


def _sig_array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, CHUNKS * CHUNK)


def filed(reps: DataFrame) -> DataFrame:
    """(key, id): all keys of all signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                keys = chunk_keys(_sig_array(part.column(1)))
                ids = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            ok = np.zeros(batch.num_rows, bool)
            for i in range(0, batch.num_rows, 256):
                left, right = [], []
                for out, col in ((left, batch.column(2)), (right, batch.column(3))):
                    for _, _, raw, ends in texts_of(col.slice(i, 256)):
                        h, counts = shingle_sets(raw, ends)
                        out += np.split(h, np.cumsum(counts)[:-1])
                for j, (x, y) in enumerate(zip(left, right)):
                    both = np.isin(x, y, assume_unique=True).sum()
                    ok[i + j] = DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both) and both > 0
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_pairs(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs whose signatures differ in at most FARTHEST places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pa.array((_sig_array(batch.column(2)) != _sig_array(batch.column(3))).sum(1) <= FARTHEST)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    one, two = (sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def sketched(texts: DataFrame) -> DataFrame:
    """(id, sketch) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, ends in texts_of(batch.column(1)):
                h, counts = shingle_sets(raw, ends)
                low = (_mix(h + np.uint64(77)) >> np.uint64(32)).astype("<u4")
                out = [np.sort(x)[:SKETCH].tobytes() for x in np.split(low, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.binary())], ["id", "sketch"])

    return texts.select("id", "text").mapInArrow(run, "id long, sketch binary")


def likely(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sketches may reach the threshold with ``x``."""
    top = np.iinfo(np.uint32).max
    limit = x[-1] if len(x) == SKETCH else top
    limits = np.minimum([y[-1] if len(y) == SKETCH else top for y in others], limit)
    sizes = np.array([len(y) for y in others])
    flat = np.concatenate(others)
    begin = np.cumsum(sizes) - sizes
    seen = flat <= np.repeat(limits, sizes)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    both = np.add.reduceat((x[at] == flat) & seen, begin, dtype=np.int64)
    every = np.add.reduceat(seen, begin, dtype=np.int64) + np.searchsorted(x, limits, side="right") - both
    at_least = NUMERATOR / DENOMINATOR
    margin = EDGE + np.where(limits < top, SIGMAS * np.sqrt(at_least * (1 - at_least) / np.maximum(every, 1)), 0.0)
    return both >= (at_least - margin) * every


def across(members: DataFrame, marked: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of different components under one hub.

    ``members``: (hub, id, component) of the hubs that hold several components;
    ``marked``: (id, sig, sketch). Blocks of a hub meet pair by pair.
    """

    def run(part: pa.Table) -> Iterator[pa.RecordBatch]:
        key, bi, bj = (part.column(c).to_numpy() for c in ("hub", "bi", "bj"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        ids, comp, own = (part.column(c).to_numpy() for c in ("id", "component", "own"))
        sig, sketches = _sig_array(part.column("sig")), [np.frombuffer(x, "<u4") for x in part.column("sketch").to_pylist()]
        edges = np.append(np.flatnonzero(new), len(key))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if e - s < 2:
                continue
            left = np.arange(s, e) if bi[s] == bj[s] else s + np.flatnonzero(own[s:e] == bi[s])
            right = left if bi[s] == bj[s] else s + np.flatnonzero(own[s:e] == bj[s])
            out_a, out_b = [], []
            for x in left.tolist():
                near = (comp[right] != comp[x]) & ((sig[right] != sig[x]).sum(1) <= FARTHEST)
                if bi[s] == bj[s]:
                    near &= ids[right] > ids[x]
                y = right[near]
                if len(y):
                    y = ids[y[likely(sketches[x], [sketches[i] for i in y.tolist()])]]
                    out_a.append(np.minimum(y, ids[x]))
                    out_b.append(np.maximum(y, ids[x]))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    dealt = blocks(members, ["hub"], "id", BLOCK).join(marked, "id").select("hub", "bi", "bj", "own", "id", "component", "sig", "sketch")
    return by_group(dealt, ["hub", "bi", "bj"], run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Each step is written and read by the next, so that a plan holds a few
    shuffles at most: the driver plans a query anew after each of its shuffles,
    and keeps the metrics of every plan. Texts are always joined by shuffle, so
    that disk grows with the input and not by a change of plan.
    """
    ship(docs.sparkSession)
    marks = cut(signed(docs, id_col, text_col))
    full = marks.where("n_shingles > 0 and id is not null")
    classes = full.groupBy("n_shingles", "s1", "s2").agg(F.min("id").alias("rep"), F.min_by("sig", "id").alias("sig"))
    classes = cut(classes)
    reps = classes.select(F.col("rep").alias("id"), "sig")

    # keys that more than one class has, with their smallest member
    keys = filed(reps)
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    shared = cut(keys.join(hubs, "key"))
    pairs = cut(shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    sigs = cut(reps.join(shared.select("id").distinct(), "id", "left_semi"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = cut(texts.join(sigs.select("id").hint("merge"), "id", "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    near = cut(near_pairs(pairs, sigs))
    links = cut(confirmed(near, texts))
    comp = stars(links)  # the smallest of a component has no row

    # hubs whose members are in more than one component
    placed = cut(shared.select("hub", "id").distinct().join(comp, "id", "left").select("hub", "id", F.coalesce("component", "id").alias("component")))
    mixed = placed.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("hub")
    rest = cut(placed.join(mixed, "hub", "left_semi"))
    sketches = sketched(texts.join(rest.select("id").distinct(), "id", "left_semi"))
    marked = cut(sigs.join(sketches, "id"))
    more = cut(across(rest, marked).join(pairs, ["a", "b"], "left_anti"))
    found = cut(confirmed(more, texts))
    if found.limit(1).count():
        before, comp = comp, stars(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found))
        forget(before)
    forget(shared, pairs, sigs, texts, near, links, placed, rest, marked, more, found)

    by_rep = classes.select("n_shingles", "s1", "s2", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("n_shingles", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = marks.join(by_rep, ["n_shingles", "s1", "s2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component; all columns stay as they are.

    Of rows that repeat (id, text) one stays; different texts under one id all do.
    """
    found = near_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(found, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return named.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
