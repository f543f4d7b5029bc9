"""Periodic runs and byte-level BPE against brute force and the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import op11_runs, op12_bytes

SCHEMA = "doc_id long, text string, ids string, runs int, lang string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, "en") for i, t in rows], SCHEMA)


def brute_runs(words, exponent=4, least=6):
    """All runs by looking at every period from every place."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def brute_collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def a_sequence(rng):
    """Words of a small alphabet with repetitions of repetitions."""
    out = rng.choices("abc"[: rng.randrange(1, 4)], k=rng.randrange(0, 30))
    for _ in range(rng.randrange(0, 4)):
        part = out[-rng.randrange(1, 8) :] or ["a"]
        out += part * rng.randrange(1, 7) + rng.choices("abcd", k=rng.randrange(0, 5))
    return out[:400]


def test_runs_agree_with_brute_force():
    rng = random.Random(11)
    many = [a_sequence(rng) for _ in range(400)] + [[], ["a"], ["a"] * 5, ["a"] * 6, list("ab") * 4, list("aab") * 3, list("abc") * 200]
    for exponent, least in ((4, 6), (2, 2), (3, 10)):
        found = op11_runs.runs([np.array([ord(w) for w in s], np.int32) for s in many], exponent, least)
        got = {}
        for d, *run in zip(*(x.tolist() for x in found)):
            got.setdefault(d, []).append(tuple(run))
        for d, s in enumerate(many):
            assert got.get(d, []) == brute_runs(s, exponent, least), (s, exponent)


def test_extensions_agree_with_brute_force():
    rng = random.Random(12)
    many = [[ord(w) for w in a_sequence(rng)] for _ in range(60)]
    flat = np.array([0] + [x for s in many for x in [*s, 0]], np.int32)
    grammar = op11_runs.Grammar(flat)
    assert not any((s[1:] != 0)[s[:-1] != 0].any() for s in grammar.sym[-1:])  # one symbol a sequence
    pairs, at = [], 1
    for s in many:
        pairs += [(at + i, at + j) for i, j in (sorted(rng.sample(range(len(s)), 2)) for _ in range(40 if len(s) > 1 else 0))]
        at += len(s) + 1
    a, b = (np.array(x) for x in zip(*pairs))
    for step in (1, -1):
        want = []
        for i, j in pairs:
            n = 0
            while flat[i + step * n] == flat[j + step * n] != 0:
                n += 1
            want.append(n)
        assert grammar.extend(a, b, step).tolist() == want


def test_runs_of_odd_rows(spark):
    text = "x  y " * 9 + "tail"  # a no-break space is part of a word
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 7), (4, text), (4, text), (5, "w" * 200_000 + " v" * 6), (6, "one two three")]
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.text) for r in op11_runs.collapse_runs(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, [], ""), (2, [], ""), (3, [], ""), (None, [(0, 7, 1)], "a"), (4, [(0, 18, 2)], "x  y tail"), (4, [(0, 18, 2)], "x  y tail"), (5, [(1, 6, 1)], "w" * 200_000 + " v"), (6, [], "one two three")], key=str
    )
    assert op11_runs.collapse_runs(docs(spark, rows).where("doc_id < 0")).count() == 0


def test_a_long_text_in_runs():
    words = ["a"] * 60_000 + list("bcd") * 20_000
    found = op11_runs.runs([np.array([ord(w) for w in words], np.int32)])
    assert list(zip(*(x.tolist() for x in found))) == [(0, 0, 60_000, 1), (0, 60_000, 60_000, 3)]


def test_runs_query_agrees_with_brute_force(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, " ".join(a_sequence(rng))) for i in range(150)] + [(1000 + i, "  ".join(rng.choices(["lorem", "ipsum", "dolor", "é"], k=rng.randrange(60)))) for i in range(150)] + [(None, "q q q q q q q"), (5000, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_runs.op11_recompression(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    n_planted = 0
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            n_planted += 1
        found = brute_runs(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (best[0] if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, found).encode()).hexdigest()
    assert n_planted > 10


def test_strongest_compares_exactly():
    assert op11_runs.strongest([(0, 12, 3), (5, 8, 2), (9, 400_000_001, 100_000_000)]) == (9, 400_000_001, 100_000_000)
    assert op11_runs.strongest([(0, 12, 3), (5, 8, 2)]) == (0, 12, 3) and op11_runs.strongest([]) is None


# ---- op12


@pytest.fixture(scope="module")
def library():
    return op12_bytes.encoding(op12_bytes.ranks_path())


TEXTS = [None, "", " ", "\n\n", "it's we'll 's'S don't", "a" * 500, "<|endoftext|> <|startoftext|>", "中文。字", "é☃𝄞\x00", "=" * 300, "x" + " " * 700, " " * 50 + "y", "tab\t\tnew\r\n 12ab34"]


def test_parts_match_like_the_whole(library):
    rng = random.Random(12)
    bits = ["'s", "'ll", "'", "a", "Zz", "é", "1", "23", " ", "  ", "\n", "\t", " ", " ", "=", "。", "中", "か", "한", "-", "𝄞", "!", "\x1c", "​", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 60)))
        for size in (1, 3, 8):
            found = list(op12_bytes.parts(text, size))
            assert "".join(p for p, _ in found) == text
            assert op12_bytes.ids_of(library, text, size) == library.encode_ordinary(text), (text, size)


def test_encoding_agrees_with_the_library(spark, library, tmp_path):
    rng = random.Random(14)
    texts = TEXTS + ["".join(rng.choices(["the ", "ing", " ", "é", "\n", "12", "中", "'re "], k=rng.randrange(200))) for _ in range(100)]
    table = docs(spark, [*enumerate(texts), (None, "same"), (0, "same")])
    path = op12_bytes.ranks_path()
    ids = op12_bytes.encoded(table, path)
    got = {r.doc_id: r.ids for r in ids.where("doc_id > 0").collect()}
    back = {r.doc_id: bytes(r.bytes) for r in op12_bytes.decoded(ids, path).where("doc_id > 0").collect()}
    table.write.parquet(f"{tmp_path}/documents.parquet")
    marks = {r.doc_id: r for r in op12_bytes.op12_rank_file(spark, str(tmp_path)).where("doc_id > 0").collect()}
    for i, text in enumerate(texts[1:], 1):
        want = library.encode_ordinary(text or "")
        assert got[i] == want and back[i] == (text or "").encode()
        assert marks[i].n_tokens == len(want)
        assert marks[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest()
        assert marks[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    odd = sorted((r.doc_id is None, r.ids) for r in ids.where("doc_id is null or doc_id = 0").collect())
    assert odd == [(False, []), (False, library.encode_ordinary("same")), (True, library.encode_ordinary("same"))]
    assert op12_bytes.encoded(table.where("doc_id < 0"), path).count() == 0


def test_very_long_texts(spark, library):
    """Without cuts the library fails on white space of a million characters."""
    runs = ["word " * 60_000, " " * 1_200_000, " " * 1_200_000 + "end", "a\n" + "\n" * 1_100_000 + " b", "x" * 300_000, "ab1," * 100_000, "中文" * 60_000 + "。" + "字" * 60_000]
    got = {r.doc_id: r.ids for r in op12_bytes.encoded(docs(spark, enumerate(runs)), op12_bytes.ranks_path()).collect()}
    assert all(library.decode_bytes(got[i]) == t.encode() for i, t in enumerate(runs))
    assert all(got[i] == library.encode_ordinary(runs[i]) for i in (0, 4, 5, 6))
    assert got[2] == library._encode_single_piece(" " * 1_199_999) + library.encode_ordinary(" end")
    assert docs(spark, enumerate(runs)).agg(F.max(F.length("text"))).first()[0] > 1_000_000
