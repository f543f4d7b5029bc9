"""SentencePiece encoding and decoding by vectorised merge rounds.

A slice of texts becomes one flat array of symbols. White space can only begin
a piece, so the text falls into words that never merge with each other, and
equal words are encoded once. Each round finds the least pair rank of every
word (a segmented minimum), merges its leftmost non-overlapping occurrences
everywhere at once, and compacts; words with no pair left drop out.

Merging all occurrences at once equals merging them one by one as long as no
piece outranks a part it is built from; for the few pieces that do, only the
leftmost occurrence is merged in a round.

Null texts are encoded as empty ones (begin and end ids only). Null ids and
repeated rows pass through row by row; other columns are not read. Empty table:
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters that are encoded together; bounds the memory of a task, a single longer text aside.
SLICE_CHARS = 2_000_000
#: Encoded words that a worker keeps for its next slices.
KEPT_WORDS = 400_000
NONE = np.int32(2**31 - 1)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Pieces:
    """A BPE model with byte fallback as arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a BPE model without text normalisation is needed")
        if not (model.normalizer_spec.add_dummy_prefix and model.normalizer_spec.escape_whitespaces and model.trainer_spec.byte_fallback):
            raise ValueError("a model with a leading space and byte fallback is needed")
        self.bos, self.eos = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        scores = {i: model.pieces[i].score for i in ids.values()}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces with inner white space are not supported")
        place = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank_of = np.full(len(model.pieces), NONE, np.int32)
        for i, s in scores.items():
            self.rank_of[i] = place[s]
        pairs, unsafe = {}, set()
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
                    unsafe |= {x for x, n in ((a, k), (b, len(piece) - k)) if n > 1 and scores[x] <= scores[i]}
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.merged = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        self.alone = np.zeros(len(model.pieces), bool)
        self.alone[list(unsafe)] = True
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.byte = np.zeros(256, np.int32)
        surface = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
                surface.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                surface.append(p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"")
        self.length = np.array([len(x) for x in surface], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.forget_words()

    def forget_words(self) -> None:
        """Empty the store of encoded words."""
        self.hashes, self.where = np.zeros(0, np.uint64), np.zeros((4, 0), np.int64)
        self.kept_cps, self.kept_ids = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], -1).astype(np.int32)

    def merge(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words (code points, or ids below -1 for none) to ids; and the words' lengths."""
        n_words = len(starts)
        sizes = np.diff(np.append(starts, len(sym)))
        word = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
        done_sym, done_word = [], []
        made = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        made[inner] = self._pairs(sym[inner], sym[inner + 1])
        while len(sym):
            rank = np.where(made >= 0, self.rank_of[made], NONE)
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(begin, len(sym)))
            best = np.minimum.reduceat(rank, begin)
            over = np.repeat(best == NONE, size)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
                live = best != NONE
                best, size = best[live], size[live]
                if not len(sym):
                    break
                begin = np.cumsum(size) - size
            hit = rank == np.repeat(best, size)
            at = np.flatnonzero(hit)
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
            run = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            at = at[(at - run) % 2 == 0]
            careful = self.alone[made[at]]
            if careful.any():
                leading = np.concatenate(([True], word[at][1:] != word[at][:-1]))
                slow = np.zeros(n_words, bool)
                slow[word[at[careful]]] = True
                at = at[leading | ~slow[word[at]]]
            sym = sym.copy()
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new_at = at - np.arange(len(at))
            sym, word, made = sym[keep], word[keep], made[keep]
            mark = np.zeros(len(sym), bool)
            mark[new_at] = True
            mark[new_at[new_at > 0] - 1] = True
            touched = np.flatnonzero(mark)
            last = touched + 1 >= len(sym)
            nxt = np.where(last, touched, touched + 1)
            pair = self._pairs(sym[touched], sym[nxt])
            made[touched] = np.where(last | (word[nxt] != word[touched]), -1, pair)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n_words)

    def _words(self, cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        known = self.char[cps]
        # a character that is no piece stays as its code point below -1 and becomes bytes at the end
        sym = np.where(known >= 0, known, -2 - cps.astype(np.int32))
        ids, counts = self.merge(sym, starts)
        lost = np.flatnonzero(ids < -1)
        if len(lost):
            word = np.repeat(np.arange(len(starts)), counts)
            raw = [chr(-2 - x).encode() for x in ids[lost].tolist()]
            width = np.ones(len(ids), np.int64)
            width[lost] = [len(x) for x in raw]
            out = np.repeat(ids, width)
            fill = np.repeat(ids < -1, width)
            out[fill] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
            counts = np.bincount(np.repeat(word, width), minlength=len(starts))
            ids = out
        return ids, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end ids, and the number of each text's."""
        joined = "".join([SPACE + t if t else "" for t in texts]).replace(" ", SPACE)
        chars = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not joined:
            return np.tile(np.array([self.bos, self.eos], np.int32), len(texts)), np.full(len(texts), 2, np.int64)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        doc_start = np.cumsum(chars) - chars
        space = cps == ord(SPACE)
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[doc_start[chars > 0]] = True
        starts = np.flatnonzero(begins)
        inverse, first, hashes = self._distinct(cps, starts)
        u_ids, u_count = self._looked_up(cps, starts, first, hashes)
        u_start = np.cumsum(u_count) - u_count
        lens = u_count[inverse]
        doc_of_word = np.searchsorted(doc_start[chars > 0], starts, side="right") - 1
        of_doc = np.flatnonzero(chars > 0)[doc_of_word]
        counts = np.bincount(of_doc, weights=lens, minlength=len(texts)).astype(np.int64) + 2
        total = int(counts.sum())
        out = np.empty(total, np.int32)
        doc_at = np.cumsum(counts) - counts
        body = np.ones(total, bool)
        body[doc_at] = False
        body[doc_at + counts - 1] = False
        shift = u_start[inverse] - (np.cumsum(lens) - lens)
        out[body] = u_ids[np.repeat(shift, lens) + np.arange(int(lens.sum()))]
        out[doc_at], out[doc_at + counts - 1] = self.bos, self.eos
        return out, counts

    def _distinct(self, cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each word, the first word of each class and its hash; classes are checked symbol by symbol."""
        sizes = np.diff(np.append(starts, len(cps)))
        place = np.arange(len(cps)) - np.repeat(starts, sizes)
        hashes = np.add.reduceat(_mix(cps + (place.astype(np.uint64) << np.uint64(32)) + np.uint64(1)), starts)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        like = first[inverse]
        if np.array_equal(sizes, sizes[like]) and np.array_equal(cps[np.repeat(starts[like], sizes) + place], cps):
            return inverse, first, distinct
        return np.arange(len(starts)), np.arange(len(starts)), hashes

    def _looked_up(self, cps: np.ndarray, starts: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct words, from the store where they are in it."""
        sizes = np.diff(np.append(starts, len(cps)))[first]
        begin = np.cumsum(sizes) - sizes
        flat = cps[np.repeat(starts[first] - begin, sizes) + np.arange(int(sizes.sum()))]
        there = np.zeros(len(first), bool)
        at = np.zeros(len(first), np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            there = (self.hashes[at] == hashes) & (self.where[1, at] == sizes)
            n = sizes[there]
            low = np.cumsum(n) - n
            same = self.kept_cps[np.repeat(self.where[0, at[there]] - low, n) + np.arange(int(n.sum()))] == flat[np.repeat(there, sizes)]
            if not same.all():
                there[:] = False
        new = ~there
        fresh, counts_new = np.zeros(0, np.int32), np.zeros(0, np.int64)
        new_flat = flat[np.repeat(new, sizes)]
        new_begin = np.cumsum(sizes[new]) - sizes[new]
        if new.any():
            fresh, counts_new = self._words(new_flat, new_begin)
        counts = np.empty(len(first), np.int64)
        counts[new], counts[there] = counts_new, self.where[3, at[there]]
        out = np.empty(int(counts.sum()), np.int32)
        is_new = np.repeat(new, counts)
        out[is_new] = fresh
        n = counts[there]
        low = np.cumsum(n) - n
        out[~is_new] = self.kept_ids[np.repeat(self.where[2, at[there]] - low, n) + np.arange(int(n.sum()))]
        if len(self.hashes) + len(hashes) > KEPT_WORDS:
            self.forget_words()
        short = new & (sizes <= 64)
        if short.any():
            pick = np.repeat(short[new], sizes[new])
            pick_ids = np.repeat(short[new], counts_new)
            rows = np.array([len(self.kept_cps) + np.cumsum(sizes[short]) - sizes[short], sizes[short], len(self.kept_ids) + np.cumsum(counts[short]) - counts[short], counts[short]])
            self.kept_cps, self.kept_ids = np.concatenate((self.kept_cps, new_flat[pick])), np.concatenate((self.kept_ids, fresh[pick_ids]))
            all_hashes = np.concatenate((self.hashes, hashes[short]))
            order = np.argsort(all_hashes, kind="stable")
            self.hashes, self.where = all_hashes[order], np.concatenate((self.where, rows), axis=1)[:, order]
        return out, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all id sequences, and how many each has; the leading space goes."""
        width = self.length[ids]
        total = int(width.sum())
        at = self.first[ids] - (np.cumsum(width) - width)
        flat = self.surface[np.repeat(at, width) + np.arange(total)]
        begin = np.cumsum(counts) - counts
        sizes = np.add.reduceat(width, begin) if len(counts) else np.zeros(0, np.int64)
        start = np.cumsum(sizes) - sizes
        lead = np.zeros(len(counts), bool)
        some = sizes > 0
        lead[some] = flat[start[some]] == 0x20
        keep = np.ones(total, bool)
        keep[start[lead]] = False
        return flat[keep], sizes - lead


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids of every text with begin and end, and the text that they decode to."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                ids, counts = model.encode(texts[a:b])
                flat, sizes = model.decode(ids, counts)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                text = pa.StringArray.from_buffers(b - a, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(ids)), text], ["doc_id", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), so that ids need not leave the task."""
    ship(docs.sparkSession)
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                ids, counts = model.encode(texts[a:b])
                flat, sizes = model.decode(ids, counts)
                raw, at = memoryview(ids.astype("<u4")).cast("B"), np.concatenate(([0], np.cumsum(counts) * 4)).tolist()
                text, ends = memoryview(flat), np.concatenate(([0], np.cumsum(sizes))).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(counts, pa.int64()),
                        pa.array([sha256(raw[x:y]).hexdigest() for x, y in zip(at, at[1:])]),
                        pa.array([sha256(text[x:y]).hexdigest() for x, y in zip(ends, ends[1:])]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
