"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

A long text is cut before the library's pattern sees it, at places where one of
the pattern's matches must end whatever stands around: between a character and
the white space after it, between a letter and a digit, mark or the reverse
where no contraction can span it. The matches of the parts are then the matches
of the text, and the library's backtracking stays within a part. White space
that goes on for longer than a part is one match but for its last character
(which begins the next word), and is handed to the library as that match. A run
of letters or marks without any safe place stays whole. Decoding joins the
tokens' bytes; nothing is replaced, so the bytes are those of the text.

Each text is a row of its own; nothing is shuffled. Null texts are encoded as
empty ones (no ids). Null ids and repeated rows pass through row by row. Very
long texts: whole, in parts. Ties of ranks: none, ranks are distinct, and the
leftmost of equal pairs is merged first. Other columns are not read, so their
names can't clash. Empty table: no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table

if TYPE_CHECKING:
    import tiktoken

RANKS = "byte_bpe_50k.tiktoken"
#: A text of more characters is cut at safe places about so far apart; longer white space is a part of its own.
PART = 100_000
#: Ids that a record batch holds before it is handed on.
BATCH_IDS = 2_000_000

#: White_Space of Unicode, which the pattern's classes are made of whatever the version of the tables.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTER, _MARK = "A-Za-z\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fff\\uac00-\\ud7a3", "!-/:-@\\[-`{-~\\u3001\\u3002\\uff0c"
#: Where a match must end: before white space; between a letter or digit and another class; a mark before a letter may be a contraction.
SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[{_LETTER}])(?=[0-9{_MARK}])|(?<=[0-9])(?=[{_LETTER}{_MARK}])|(?<=[{_MARK}])(?=[0-9])")


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str | None = None) -> tiktoken.Encoding:
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[tuple[str, bool]]:
    """The text in parts that the pattern matches like the whole, and whether a part is one match by itself."""
    at = 0
    if len(text) <= size:
        if text:
            yield text, False
        return
    for run in re.finditer(f"[{SPACE}]{{{size},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((p, False) for p in _cut(text[at : run.start()], size))
        if end > run.start():
            yield text[run.start() : end], True
        at = end
    yield from ((p, False) for p in _cut(text[at:], size))


def _cut(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        place = SAFE.search(text, at + size)
        if not place:
            break
        yield text[at : place.start()]
        at = place.start()
    if at < len(text):
        yield text[at:]


def ids_of(model: tiktoken.Encoding, text: str | None, size: int = PART) -> list[int]:
    """Ids of a text, special tokens' strings being ordinary text."""
    out: list[int] = []
    for part, one in parts(text or "", size):
        out += model._encode_single_piece(part) if one else model.encode_ordinary(part)
    return out


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoding(path)
        for batch in batches:
            held: list[np.ndarray] = []
            a = total = 0
            for i, text in enumerate(batch.column(1)):
                held.append(np.array(ids_of(model, text.as_py()), np.int32))
                total += len(held[-1])
                if total >= BATCH_IDS or i == batch.num_rows - 1:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(held)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held)))], ["doc_id", "ids"])
                    held, a, total = [], i + 1, 0

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decoded(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes that every list of ids stands for; null lists are empty, unknown ids an error."""
    ship(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoding(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode_bytes(x.as_py() or []) for x in batch.column(1)], pa.binary())], ["doc_id", "bytes"])

    return ids.select(id_col, ids_col).mapInArrow(run, f"doc_id {ids.schema[id_col].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), so that ids need not leave the task."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoding(path)
        for batch in batches:
            n, by_ids, by_bytes = [], [], []
            for text in batch.column(1):
                ids = ids_of(model, text.as_py())
                n.append(len(ids))
                by_ids.append(sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                by_bytes.append(sha256(model.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_rank_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), ranks_path())
