"""Periodic runs of words by recompression, and texts with the runs collapsed.

A run is a stretch of words with smallest period q, at least ``EXPONENT`` * q
and ``LEAST`` words long, that no neighbouring word extends keeping the period.
Texts of a slice lie side by side as one array of word numbers, parted by
sentinels. Recompression alternates two steps until each text is one symbol:
blocks of one symbol become a symbol of (symbol, count), and of each pair of
neighbours whose first symbol falls into the left half of the symbols and whose
second falls into the right half one symbol is made. The levels are a run-length
grammar; equal stretches are cut alike but for their ends, so the longest common
extension of two places climbs level by level with at most one comparison each,
and descends from the first difference in the same way, all queries at once.

Candidates come from a harmonic grid: a run with period q holds a multiple of
``(EXPONENT - 1) * q`` (counted from the text's first word) whose word, and those
of the neighbouring multiples of q, come again q words later; there are
n * log(n) grid places, and the few that agree are extended both ways by the
grammar. Each run is found for its multiples as well, as the same stretch, and
the smallest period is kept. Names of symbols are exact, not hashes.

Every text is a task-side row of its own and nothing is shuffled. Null and empty
texts and texts of white space: no words, no runs. Null ids: rows of their own
(in the query: nothing is planted in them). Very long texts: whole; a task holds
about 200 bytes a word of the longest one. Repeated rows: alike. Ties of exponent
go to the smaller start, then period. Other columns are not read, so their names
can't clash. Empty table: no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table

#: A run is at least EXPONENT times its period and LEAST words long.
EXPONENT, LEAST = 4, 6
#: Characters that are worked on together, grid places and extensions at once; they bound a task's memory, a single longer text aside.
SLICE_CHARS, GRID, QUERIES = 1_500_000, 2_000_000, 500_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Grammar:
    """Levels of symbols over an array whose sequences stand between zeros (sentinels)."""

    def __init__(self, symbols: np.ndarray):
        self.sym = [np.asarray(symbols, np.int32)]
        self.up: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.block: list[bool] = []
        self.fresh = int(symbols.max(initial=0)) + 1
        turn = 0
        while True:
            s = self.sym[-1]
            live = (s[1:] != 0) & (s[:-1] != 0)
            if not live.any():
                break
            if turn % 2 == 0:
                self._level(live & (s[1:] == s[:-1]), True)
            else:
                # another half of the symbols each time: the top bit of a product with an odd number
                right = (s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn * 0x632BE59BD9B4E019 & (1 << 64) - 1) >> np.uint64(63)).astype(bool)
                self._level(live & ~right[:-1] & right[1:], False)
            turn += 1

    def _level(self, joined: np.ndarray, block: bool) -> None:
        """One level up: ``joined`` tells which symbols go on the phrase of the one before them."""
        if not joined.any():
            return
        s = self.sym[-1]
        head = np.concatenate(([True], ~joined))
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(s)))
        new = s[first]
        longer = np.flatnonzero(size > 1)
        other = size[longer] if block else s[first[longer] + 1]
        _, name = np.unique(new[longer].astype(np.int64) << 32 | other.astype(np.int64), return_inverse=True)
        new[longer] = self.fresh + name
        self.fresh += int(name.max()) + 1
        self.sym.append(new)
        self.up.append((np.cumsum(head) - 1).astype(np.int32))
        self.first.append(np.append(first, len(s)).astype(np.int32))
        self.block.append(block)

    def extend(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many symbols from a and from b (a < b, in one sequence) are equal going right (step 1) or left (step -1)."""
        begin, a, b = a, a.astype(np.int64), b.astype(np.int64)
        level = np.full(len(a), len(self.up), np.int64)
        climbing = np.arange(len(a))
        for t, (s, up, first) in enumerate(zip(self.sym, self.up, self.first)):
            x, y = a[climbing], b[climbing]
            same = s[x] == s[y]
            level[climbing[~same]] = t
            climbing, x, y = climbing[same], x[same], y[same]
            if not len(climbing):
                break
            px, py = up[x], up[y]
            # symbols of the phrase from here on, and before here
            rx, ry = (first[px + 1] - x, first[py + 1] - y) if step > 0 else (x - first[px] + 1, y - first[py] + 1)
            whole = (rx == first[px + 1] - first[px]) & (ry == first[py + 1] - first[py])
            move = np.where(whole, 0, np.minimum(rx, ry)) * step
            a[climbing], b[climbing] = x + move, y + move
            apart = ~whole & (rx != ry)
            level[climbing[apart]] = t
            climbing = climbing[~apart]
            a[climbing], b[climbing] = up[a[climbing]], up[b[climbing]]
        for t in range(len(self.up), 0, -1):
            at = np.flatnonzero(level >= t)
            if not len(at):
                continue
            first, s = self.first[t - 1], self.sym[t - 1]
            px, py = a[at], b[at]
            x, y = (first[px], first[py]) if step > 0 else (first[px + 1] - 1, first[py + 1] - 1)
            same = np.minimum(first[px + 1] - first[px], first[py + 1] - first[py]) if self.block[t - 1] else 1
            move = np.where(s[x] == s[y], same, 0) * step
            a[at], b[at] = x + move, y + move
        return (a - begin) * step


def runs(sequences: list[np.ndarray], exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, length, period) of all runs of sequences of positive numbers, by sequence, start and period."""
    size = np.array([len(s) for s in sequences], np.int64)
    flat = np.zeros(int(size.sum()) + len(size) + 1, np.int32)
    offset = np.cumsum(size + 1) - size
    if size.sum():
        flat[np.repeat(offset - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = np.concatenate(sequences)
    place, period, of = _candidates(flat, offset, size, exponent)
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grammar = Grammar(flat)
    found = []
    for k in range(0, len(place), QUERIES):
        i, q, d = place[k : k + QUERIES], period[k : k + QUERIES], of[k : k + QUERIES]
        start = i - grammar.extend(i - 1, i + q - 1, -1)
        length = i + q + grammar.extend(i, i + q, 1) - start
        run = length >= np.maximum(least, exponent * q)
        # by stretch, the smallest period first
        rows = np.stack((d, start, length, q))[:, run]
        found.append(np.unique(rows, axis=1))
    d, start, length, q = np.unique(np.concatenate(found, axis=1), axis=1)
    first = np.concatenate(([True], (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(d) else np.zeros(0, bool)
    d, start, length, q = d[first], start[first], length[first], q[first]
    order = np.lexsort((q, start, d))
    d, start, length, q = d[order], start[order], length[order], q[order]
    return d, start - offset[d], length, q


def _candidates(flat: np.ndarray, offset: np.ndarray, size: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid places, periods and sequences that may be part of a run."""
    periods = size // exponent
    of = np.repeat(np.arange(len(size)), periods)
    q_all = np.arange(len(of)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    n_grid = -(-(size[of] - q_all) // ((exponent - 1) * q_all))
    ends = np.cumsum(n_grid)
    out = []
    a = 0
    while a < len(of):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GRID, side="right")))
        n = n_grid[a:b]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat(q_all[a:b], n)
        i = np.repeat(offset[of[a:b]], n) + k * (exponent - 1) * q
        hit = np.flatnonzero(flat[i] == flat[i + q])
        i, q, d = i[hit], q[hit], np.repeat(of[a:b], n)[hit]
        low, high = offset[d], offset[d] + size[d]
        count = np.ones(len(i), np.int64)
        for step in (1, -1):  # neighbouring multiples of the period that agree as well
            on = np.ones(len(i), bool)
            for j in range(1, exponent - 1):
                x = i + step * j * q
                on &= (x >= low) & (x + q < high)
                x = np.where(on, x, i)
                on &= flat[x] == flat[x + q]
                count += on
        keep = count >= exponent - 1
        out.append((i[keep], q[keep], d[keep]))
        a = b
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words with a repetition in every tenth document, by a checksum of its id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


Found = tuple[int, list[str], list[tuple[int, int, int]]]


def _in_slices(ids: list, texts: list[str | None], change: Callable[[int | None, list[str]], list[str]] | None, exponent: int, least: int) -> Iterator[list[Found]]:
    """For slices of the rows: row number, words, and runs as (start, length, period)."""
    a = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars < SLICE_CHARS and i < len(texts) - 1:
            continue
        words = [WORD.findall(x or "") for x in texts[a : i + 1]]
        if change:
            words = [change(k, w) for k, w in zip(ids[a : i + 1], words)]
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = lambda: len(number) + 1  # noqa: B023  called in this slice only
        found = runs([np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in words], exponent, least)
        by_row: defaultdict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for d, start, length, q in zip(*(x.tolist() for x in found)):
            by_row[d].append((start, length, q))
        yield [(a + k, w, by_row.get(k, [])) for k, w in enumerate(words)]
        a, chars = i + 1, 0


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by single spaces."""
    if not found:
        return " ".join(words)
    keep = bytearray(b"\1") * len(words)
    reach = 0
    for start, length, q in found:  # by start: what reaches no further than those before adds only what lies past its own first period
        keep[start + q : start + length] = bytes(length - q)
        reach = max(reach, start + length)
    return " ".join([w for w, k in zip(words, keep) if k])


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties go to the smaller start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, text): every run (word number, length, period) and the text with the runs collapsed."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _in_slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), None, exponent, least):
                found = [[{"start": s, "length": n, "period": q} for s, n, q in f] for _, _, f in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows[0][0], len(rows)), pa.array(found, kind), pa.array([collapsed(w, f) for _, w, f in rows], pa.string())], ["doc_id", "runs", "text"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document (with its planted repetition) as digests, so that words need not leave the task."""
    docs = table(spark, sf_dir, "documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _in_slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), planted, EXPONENT, LEAST):
                best = [strongest(f) for _, _, f in rows]
                part = lambda k: pa.array([b and b[k] for b in best], pa.int64())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(rows[0][0], len(rows)),
                        pa.array([len(f) for _, _, f in rows], pa.int64()),
                        part(0),
                        part(1),
                        part(2),
                        pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
                        pa.array([sha256("".join(f"{s},{n},{q}\n" for s, n, q in f).encode()).hexdigest() for _, _, f in rows]),
                        pa.array([sha256(collapsed(w, f).encode()).hexdigest() for _, w, f in rows]),
                    ],
                    ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
