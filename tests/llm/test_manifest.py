"""The Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import pytest

from lexigrove.llm import op13_manifest as op13

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int, root string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(digests, arity=8):
    """The top digest and, of every digest, the siblings left and right on each level."""
    at, proofs, level = list(range(len(digests))), [[] for _ in digests], list(digests)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // arity * arity : k // arity * arity + arity]
            proofs[i].append(("".join(run[: k % arity]), "".join(run[k % arity + 1 :])))
        level = [sha("".join(level[k : k + arity])) for k in range(0, len(level), arity)]
        at = [k // arity for k in at]
    return level[0], proofs


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by_lang = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    tops = {g: tree([leaf(r) for r in rs]) for g, rs in by_lang.items()}
    root, above = tree([tops[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above):
        for r, own in zip(by_lang[g], tops[g][1]):
            x = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for low, high in own + up:
                x = sha(low + x + high)
            out.append((r[0], leaf(r), tops[g][0], root, own + up, x))
    return out


def some_rows(rng, sizes):
    ids = iter(rng.sample(range(100_000), sum(sizes.values())))
    words = ["Alpha", "beta", "É", "☃", "x" * 300, "", "MIXED Case"]
    return [(next(ids), rng.choice([None, " ".join(rng.choices(words, k=4))]), g, rng.choice([None, "web", "größe"]), rng.choice([None, 5])) for g, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("sizes", [{"en": 700, "de": 65, None: 9, "é": 1, "z": 8, "": 3}, {"en": 1}, {None: 64}, {"a": 1, "b": 1}, {f"l{i}": 1 + i % 3 for i in range(80)}])
def test_manifest_agrees_with_plain_python(spark, sizes, tmp_path):
    rows = some_rows(random.Random(13), sizes)
    random.Random(1).shuffle(rows)
    want = sorted(plain(rows))
    got = sorted((r.doc_id, r.leaf, r.subroot, r.root, [tuple(x) for x in r.proof]) for r in op13.manifest(docs(spark, rows), fan=5).collect())
    assert got == [w[:5] for w in want]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    marks = sorted(tuple(r) for r in op13.op13_pointer_jumping(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert marks == [(*w[:4], sha("".join(a + b for a, b in w[4])), w[5], w[5] == w[3]) for w in want]
    assert all(m[6] for m in marks if zlib.crc32(str(m[0]).encode()) % 3)


def test_odd_rows(spark):
    rows = [(None, "a", "en", "s", 1)] * 3 + [(5, "b", "en", "s", 1)] * 20 + [(5, "c", "en", "s", None), (6, "d" * 500_000, None, None, None)]
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(x) for x in r.proof]) for r in op13.manifest(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((w[:5] for w in plain(rows)), key=str)
    assert op13.manifest(docs(spark, rows).where("doc_id < 0")).count() == 0


def test_a_changed_row_is_found(spark):
    rows = some_rows(random.Random(3), {"en": 90, "de": 4})
    proofs = op13.manifest(docs(spark, rows))
    changed = proofs.withColumn("ok", op13.fold(proofs["leaf"], proofs["proof"]) == proofs["root"]).withColumn("bad", op13.fold(op13.leaf_of([proofs["doc_id"]]), proofs["proof"]) == proofs["root"])
    assert {(r.ok, r.bad) for r in changed.collect()} == {(True, False)}
