"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if some LENGTH-byte string over it also starts earlier: in a
document with a smaller id, or earlier in the same one. Suffixes are compared
only where they can agree. Every string of LENGTH bytes has an anchor, the
least hash among the GRAM-byte strings in it, so equal strings have equal
anchors at equal places. The starts that share an anchor are one segment of at
most 2 * LENGTH - GRAM bytes, and a document is some 35 bytes a segment.

1. Each task names its segments by anchor (64 bits) and content (96 bits);
   equal segments are copies as a whole, so only the first of each goes on
   (before the shuffle and after it), the others are removed. Segments whose
   anchor nothing else has are done.
2. Of anchors with several different segments, the bytes are fetched once. Per
   block of anchors the suffixes at the starts are put in order, with the bytes
   that neighbours share. The previous and the next smaller place in that order
   are each start's best earlier matches; the longer of the two is its longest
   previous factor (to LENGTH bytes, the longest that can decide). A start goes
   if its factor reaches LENGTH. Groups with more than GROUP segments are dealt
   out by the content of each start.
3. Removed ranges are united per row and cut from its bytes.

Rows are told apart by (id, 64-bit hash of the text). Null and empty texts: no
bytes. Null ids come after all others. Rows with one id and different texts,
null ids among them, are in order of that hash, so the first of their repeated
passages stays too. Equal rows are the same place: neither is earlier, and both
get the same ranges. A very long text is a slice of its own, worked on whole.
Other columns are not read, so their names can't clash. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, cut, release, ship, table, tasks
from .op6_minhash import _BASE, _BYTES, _mix, _powers, texts_of

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: Different segments of one anchor that one block compares.
GROUP = 4096
#: Bytes of segments whose suffixes are sorted together.
SORT_BYTES = 4_000_000
LAST_ID = np.int64(2**63 - 1)
#: Bytes of text that one bucket stands for.
BUCKET_BYTES = 64_000_000
#: Bits for the place beside the hash in one word; a slice can't be longer than a Java string.
_PLACE = 32
_MORE_BYTES = _mix(_BYTES + np.uint64(0x9E3779B97F4A7C15))


def _inverse_powers(n: int) -> np.ndarray:
    inverse = np.array([pow(int(_BASE), -1, 2**64)], np.uint64)
    out = np.repeat(inverse, n)
    out[0] = 1
    return np.multiply.accumulate(out)


def segments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first start, starts, place of the anchor, anchor hash, two segment hashes) of every segment, in order.

    ``raw`` holds the documents one after another; starts count from the document's first byte.
    """
    n = len(raw)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint32))
    if n < LENGTH:
        return none
    power, inverse = _powers(n + 1), _inverse_powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[:n], out=total[1:])
    gram = _mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    low = ((gram >> np.uint64(_PLACE)) << np.uint64(_PLACE)) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= WINDOW:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span :])
    anchor = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)  # of each start
    begins = np.concatenate(([0], ends[:-1]))
    some = ends - begins >= LENGTH
    if not some.any():
        return none
    valid = np.zeros(n + 1, np.int64)
    np.add.at(valid, begins[some], 1)
    np.add.at(valid, ends[some] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(valid)[: len(anchor)] > 0)
    q = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (q[1:] != q[:-1]) | (start[1:] != start[:-1] + 1)
    # two documents can't share an anchor: it lies within each start's own bytes
    at = np.flatnonzero(new)
    first, count, q = start[at], np.diff(np.append(at, len(start))), q[at]
    doc = np.searchsorted(ends, first, side="right")
    stop = first + count - 1 + LENGTH
    shape = _mix((count.astype(np.uint64) << np.uint64(32)) + (q - first).astype(np.uint64))
    name = _mix((total[stop] - total[first]) * inverse[first] + shape)
    np.cumsum(_MORE_BYTES[raw] * power[:n], out=total[1:])
    more = _mix((total[stop] - total[first]) * inverse[first] + shape) >> np.uint64(32)
    return doc, first - begins[doc], count, q - first, gram[q], name, more.astype(np.uint32)


def firsts(names: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are later than an earlier one of their name, and which go on: the earliest, one of each if rows repeat.

    ``place``: (id, tag, start), in this order.
    """
    n = len(place[0])
    later, on = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        order = np.lexsort((*reversed(place), *names))
        new = np.zeros(n, bool)
        new[0] = True
        for x in names:
            new[1:] |= x[order][1:] != x[order][:-1]
        # a row at the place of the earliest one (a repeated row) is not later than it
        lead = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
        same = np.ones(n, bool)
        for x in place:
            same &= x[order] == x[lead]
        later[order], on[order] = ~same, new
    return later, on


def unite(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges that overlap or touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def suffix_order(data: np.ndarray, at: np.ndarray, place: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The starts ``at`` in suffix order (ties by place), and the bytes that each shares with the one before it; to ``length`` bytes.

    Eight bytes are compared at a time; only starts that are still tied go on.
    """
    word = np.zeros(len(data), np.uint64)
    for j in range(8):
        word[: len(data) - j] |= data[j:].astype(np.uint64) << np.uint64(56 - 8 * j)
    tied = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    rank = np.zeros(len(at), np.int64)
    shared = np.full(len(at), length, np.int32)
    for step in range(0, length, 8):
        step = min(step, length - 8)
        key = word[at[tied] + step]
        order = np.lexsort((key, group))
        tied, key, group = tied[order], key[order], group[order]
        lead = np.ones(len(tied), bool)
        lead[1:] = group[1:] != group[:-1]
        new = lead.copy()
        new[1:] |= key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(tied)))
        base = np.repeat(begin, size)
        rank[tied] += base - np.maximum.accumulate(np.where(lead, np.arange(len(tied)), 0))
        # where a subgroup parts from the one before it, neighbours share the bytes so far and some of this word
        parts = begin[~lead[begin]]
        apart = key[parts] ^ key[parts - 1]
        equal = np.zeros(len(parts), np.int32)
        for j in range(1, 8):
            equal += (apart >> np.uint64(64 - 8 * j)) == 0
        shared[rank[tied[parts]]] = step + equal
        more = np.repeat(size > 1, size)
        tied, group = tied[more], base[more]
        if not len(tied):
            break
    if len(shared):
        shared[0] = 0
    return np.lexsort((place, rank)), shared


def _nearest_smaller(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The bytes that each suffix shares with the previous one of a smaller place (0 if there is none).

    Every suffix looks at its neighbour; while that one's place isn't smaller,
    it goes on to what that one looks at. ``shared`` falls to the least on the way.
    """
    to = np.arange(len(place)) - 1
    low = shared.copy()
    going = np.flatnonzero((to >= 0) & (place[to] >= place))
    while len(going):
        through = to[going]
        low[going], to[going] = np.minimum(low[going], low[through]), to[through]
        there = to[going]
        going = going[(there >= 0) & (place[there] >= place[going])]
    return np.where(to >= 0, low, 0)


def previous_factors(order: np.ndarray, shared: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array: for each start, how many bytes also start at a smaller place.

    In suffix order nothing beyond the previous and the next smaller place can
    share more than they do.
    """
    p = place[order]
    before = _nearest_smaller(p, shared)
    after = _nearest_smaller(p[::-1], np.append(shared[1:], 0)[::-1].astype(shared.dtype))[::-1] if len(p) else before
    out = np.zeros(len(order), shared.dtype)
    out[order] = np.maximum(before, after)
    return out


# ---- Spark stages

#: Kinds of rows: first segments that are still to be compared, removed ranges, segments of anchors that several share.
FIRST, GONE, SHARED = 0, 1, 2
_TYPES = (("ids", "<i8"), ("tags", "<i8"), ("starts", "<u4"), ("counts", "u1"), ("places", "u1"), ("anchors", "<u8"), ("names", "<u8"), ("more", "<u4"))
_ROWS = "bucket int, kind int, " + ", ".join(f"{n} binary" for n, _ in _TYPES)
_RANGES = "id long, tag long, kind int, data binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "kind", *(n for n, _ in _TYPES)])


def _ranges(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int, more: np.ndarray | None = None) -> pa.RecordBatch:
    """(id, tag, kind, data) rows, a row's ranges together as pairs of unsigned 32-bit integers (and ``more`` after them); ranges that equal rows share are told once."""
    order = np.lexsort((end, start, tag, doc))
    if more is None and len(order):
        a, b = order[1:], order[:-1]
        order = order[np.concatenate(([True], (doc[a] != doc[b]) | (tag[a] != tag[b]) | (start[a] != start[b]) | (end[a] != end[b])))]
    doc, tag = doc[order], tag[order]
    at = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))) if len(doc) else np.zeros(0, np.int64)
    flat = np.stack((start[order], end[order]) if more is None else (start[order], end[order], *(m[order] for m in more.T)), axis=1).astype("<u4")
    raw, width = flat.tobytes(), flat.shape[1] * 4
    edge = np.append(at, len(doc)) * width
    data = [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), pa.array(tag[at], pa.int64()), pa.array(np.full(len(at), kind, np.int32)), pa.array(data, pa.binary())], ["id", "tag", "kind", "data"])


def _scan(docs: DataFrame, buckets: int) -> DataFrame:
    """Segments of all texts, dealt by anchor; copies within a slice are already ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, raw, ends in texts_of(batch.column(2)):
                doc, start, count, place, anchor, *names = segments(raw, ends)
                tag, doc = tags[a:b][doc], ids[a:b][doc]
                gone, first = firsts((*names, anchor), (doc, tag, start))
                rows = []
                if gone.any():
                    part = _ranges(doc[gone], tag[gone], start[gone], start[gone] + count[gone] - 1 + LENGTH, GONE)
                    part_ids, part_tags, data = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3).to_pylist()
                    for x in range(0, len(data), 256):
                        some = data[x : x + 256]
                        n = np.array([len(d) // 8 for d in some])
                        each = (np.repeat(v[x : x + 256], n).astype("<i8").tobytes() for v in (part_ids, part_tags))
                        rows.append(((int(part_ids[x]) + int(part_tags[x])) % buckets, GONE, *each, b"".join(some), *[b""] * 5))
                bucket = (anchor % np.uint64(buckets)).astype(np.int64)
                order = np.flatnonzero(first)
                order = order[np.argsort(bucket[order], kind="stable")]
                edge = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1]))) if len(order) else np.zeros(0, np.int64)
                columns = [np.ascontiguousarray(c[order], t) for c, (_, t) in zip((doc, tag, start, count, place, anchor, *names), _TYPES)]
                for x, y in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist()):
                    rows.append((int(bucket[order[x]]), FIRST, *(c[x:y].tobytes() for c in columns)))
                if rows:
                    yield _batch(rows)

    return docs.mapInArrow(run, _ROWS)


def _compare(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """Per bucket: later copies of a segment are removed; segments of shared anchors go on."""
    bucket, kind = part.column("bucket").to_numpy(), part.column("kind").to_numpy()
    blobs = {n: part.column(n).to_pylist() for n, _ in _TYPES}
    edge = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
        mine = [i for i in range(x, y) if kind[i] == GONE]
        if mine:
            pairs = np.frombuffer(b"".join(blobs["starts"][i] for i in mine), "<u4").reshape(-1, 2)
            yield _ranges(*(np.frombuffer(b"".join(blobs[n][i] for i in mine), "<i8") for n in ("ids", "tags")), pairs[:, 0], pairs[:, 1], GONE)
        mine = [i for i in range(x, y) if kind[i] == FIRST]
        if not mine:
            continue
        doc, tag, start, count, place, anchor, *names = (np.frombuffer(b"".join(blobs[n][i] for i in mine), t) for n, t in _TYPES)
        start, count = start.astype(np.int64), count.astype(np.int64)
        gone, first = firsts((*names, anchor), (doc, tag, start))
        if gone.any():
            yield _ranges(doc[gone], tag[gone], start[gone], start[gone] + count[gone] - 1 + LENGTH, GONE)
        doc, tag, start, count, anchor = (c[first] for c in (doc, tag, start, count, anchor))
        _, back, size = np.unique(anchor, return_inverse=True, return_counts=True)
        size = size[back]
        shared = size > 1
        if shared.any():
            # the anchor again, and whether its group is to be dealt by content
            more = np.stack(((anchor[shared] >> np.uint64(32)).astype(np.int64), (anchor[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), (size[shared] > GROUP).astype(np.int64)), axis=1)
            yield _ranges(doc[shared], tag[shared], start[shared], start[shared] + count[shared] - 1 + LENGTH, SHARED, more)


def _fetch(joined: DataFrame, buckets: int) -> DataFrame:
    """The bytes of shared segments, dealt by anchor, or one start at a time by content if the anchor has too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3).to_pylist()
            for a, b, raw, ends in texts_of(batch.column(2)):
                begins = np.concatenate(([0], ends[:-1]))
                rows = [np.frombuffer(b"".join(x), "<u4").reshape(-1, 5).astype(np.int64) for x in lists[a:b]]
                n = np.array([len(r) for r in rows])
                doc = np.repeat(np.arange(b - a), n)
                start, end, hi, lo, hot = np.concatenate(rows).T
                inside = end <= (ends - begins)[doc]
                doc, start, end, hi, lo, hot = (c[inside] for c in (doc, start, end, hi, lo, hot))
                route = (hi.astype(np.uint64) << np.uint64(32)) | lo.astype(np.uint64)
                # groups of too many segments: every start on its own
                many = np.flatnonzero(hot)
                n = end[many] - start[many] - LENGTH + 1
                one_doc = np.repeat(doc[many], n)
                one = np.repeat(start[many] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                if len(one):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * _powers(len(raw) + 1)[: len(raw)], dtype=np.uint64)))
                    at = begins[one_doc] + one
                    content = _mix((total[at + LENGTH] - total[at]) * _inverse_powers(len(raw) + 1)[at])
                    cold = hot == 0
                    doc, start, end, route = np.concatenate((doc[cold], one_doc)), np.concatenate((start[cold], one)), np.concatenate((end[cold], one + LENGTH)), np.concatenate((route[cold], content))
                bucket = (route % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                doc, start, end, route, bucket = (c[order] for c in (doc, start, end, route, bucket))
                size = end - start
                low = np.cumsum(size) - size
                flat = raw[np.repeat(begins[doc] + start - low, size) + np.arange(int(size.sum()))] if len(size) else raw[:0]
                edge = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
                out = []
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    stop = low[y] if y < len(low) else len(flat)
                    out.append((int(bucket[x]), ids[a + doc[x:y]].astype("<i8").tobytes(), tags[a + doc[x:y]].astype("<i8").tobytes(), start[x:y].astype("<u4").tobytes(), size[x:y].astype("<u4").tobytes(), route[x:y].tobytes(), flat[low[x] : stop].tobytes()))
                if out:
                    kinds = [pa.int32()] + [pa.binary()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["bucket", "ids", "tags", "starts", "sizes", "routes", "data"])

    return joined.mapInArrow(run, "bucket int, ids binary, tags binary, starts binary, sizes binary, routes binary, data binary")


def repeated(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of every start of these segments whose longest previous factor reaches LENGTH."""
    begin = np.cumsum(size) - size
    n = size - LENGTH + 1
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    own, first = np.repeat(np.arange(len(doc)), n), np.repeat(start - begin, n) + at
    by_place = np.lexsort((first, tag[own], doc[own]))
    fresh = np.ones(len(at), bool)
    a, b = by_place[1:], by_place[:-1]
    fresh[1:] = (doc[own[a]] != doc[own[b]]) | (tag[own[a]] != tag[own[b]]) | (first[a] != first[b])
    place = np.empty(len(at), np.int32)
    place[by_place] = np.cumsum(fresh)
    order, shared = suffix_order(data, at, place)
    gone = previous_factors(order, shared, place) >= LENGTH
    return own[gone], first[gone]


def _factors(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """Per bucket: ranges of the starts that were there before."""
    bucket = part.column("bucket").to_numpy()
    blobs = {n: part.column(n).to_pylist() for n in ("ids", "tags", "starts", "sizes", "routes", "data")}
    edge = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
        doc, tag, start, size, route, data = (np.frombuffer(b"".join(blobs[n][x:y]), t) for n, t in (("ids", "<i8"), ("tags", "<i8"), ("starts", "<u4"), ("sizes", "<u4"), ("routes", "<u8"), ("data", "u1")))
        start, size = start.astype(np.int64), size.astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.argsort(route, kind="stable")
        taken = np.cumsum(size[order]) // SORT_BYTES
        # a chunk ends where a route ends
        new_route = np.concatenate(([True], route[order][1:] != route[order][:-1]))
        chunk = taken[np.maximum.accumulate(np.where(new_route, np.arange(len(order)), 0))]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))), len(order))
        for u, v in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            pick = order[u:v]
            low = np.cumsum(size[pick]) - size[pick]
            flat = data[np.repeat(begin[pick] - low, size[pick]) + np.arange(int(size[pick].sum()))]
            own, s = repeated(doc[pick], tag[pick], start[pick], size[pick], flat)
            if len(own):
                d, t = doc[pick][own], tag[pick][own]
                at = np.lexsort((s, t, d))
                d, t, s = d[at], t[at], s[at]
                new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + 1))))
                yield _ranges(d[new], t[new], s[new], s[np.append(new[1:], len(s)) - 1] + LENGTH, GONE)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, id, tag, text): what tells rows apart beside the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(int(LAST_ID))).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def removed(keyed: DataFrame) -> DataFrame:
    """(id, tag, data): the removed ranges of every row that has some, as lists of packed ranges."""
    texts = keyed.select("id", "tag", "text")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(tasks(keyed), -(-size // BUCKET_BYTES))
    compared = cut(by_group(_scan(texts, buckets), ["bucket"], _compare, _RANGES, buckets))
    release(keyed.sparkSession)
    shared = compared.where(F.col("kind") == SHARED).groupBy("id", "tag").agg(F.collect_list("data").alias("data"))
    # both sides can spill
    joined = shared.hint("merge").join(texts, ["id", "tag"]).select("id", "tag", "text", "data")
    again = cut(by_group(_fetch(joined, buckets), ["bucket"], _factors, _RANGES, buckets))
    release(keyed.sparkSession)
    # a set: rows that are equal in id and text come with the same ranges, however many they are
    return compared.where(F.col("kind") == GONE).unionByName(again).groupBy("id", "tag").agg(F.collect_set("data").alias("data"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed ranges in bytes and the remaining bytes of every row."""
    ship(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    joined = keyed.join(removed(keyed).hint("merge"), ["id", "tag"], "left").select("doc_id", "text", "data")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for a, b, raw, ends in texts_of(batch.column(1)):
                spans, kept, begin = [], [], 0
                for data, end in zip(lists[a:b], ends.tolist()):
                    text = raw[begin:end]
                    if data:
                        s, e = np.frombuffer(b"".join(data), "<u4").reshape(-1, 2).astype(np.int64).T
                        s, e = unite(s, np.minimum(e, len(text)))
                        flags = np.zeros(len(text) + 1, np.int64)
                        flags[s] += 1
                        flags[e] -= 1
                        kept.append(text[np.cumsum(flags)[:-1] == 0].tobytes())
                        spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
                    else:
                        kept.append(text.tobytes())
                        spans.append([])
                    begin = end
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(np.concatenate(([0], ends))), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op2_longest_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
