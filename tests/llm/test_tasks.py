import hashlib
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import op1_pivots, op2_suffix, op3_anisotropic, op4_toxicity, op6_minhash, op7_pieces

DOCS = "doc_id long, text string, id long, key string, component long, data binary"
VECS = "vec_id long, embedding array<float>, id long, name string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "k", 6, b"x") for i, t in rows], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# ---- op2


def brute_removed(rows):
    seen, out = {}, {}
    for i, raw in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            at = seen.setdefault(raw[s : s + 100], (i, s))
            if at != (i, s):
                gone[s : s + 100] = b"\1" * 100
        out[i] = (len(raw), bytes(c for c, g in zip(raw, gone) if not g), sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_repeated_passages(spark, monkeypatch, group):
    monkeypatch.setattr(op2_suffix, "GROUP", group)
    rng = random.Random(3)
    passage, other = words(rng, 60), "é" * 90 + words(rng, 30)
    rows = [(0, None), (1, ""), (2, "short"), (3, passage), (4, passage), (5, words(rng, 20) + " " + passage[50:300] + "Q" + passage[301:] + words(rng, 10)), (6, "a" * 350), (7, "ab" * 120), (8, other + passage + other), (9, "a" * 99), (10, "a" * 100)]
    rows += [(11 + i, words(rng, 15) + passage[:150] + words(rng, 15)) for i in range(6)] + [(40, passage[40:170] + "Z" + passage[171:320]), (None, passage)]
    want = brute_removed(rows)
    got = op2_suffix.deduplicated(docs(spark, rows + rows[:4])).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        assert (r.n_bytes, bytes(r.kept), len(r.spans)) == want[r.doc_id], r.doc_id


def shared_bytes(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_suffix_order_and_factors_agree_with_brute_force():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    data[500:620] = data[100:220]
    data[230:240], data[390:400] = 99, 99
    at = np.arange(len(data) - 99)
    place = rng.permutation(len(at)).astype(np.int32)
    order, shared = op2_suffix.suffix_order(data, at, place)
    suffix = [data[i : i + 100].tobytes() for i in at]
    want = sorted(at.tolist(), key=lambda i: (suffix[i], place[i]))
    assert order.tolist() == want
    assert shared.tolist() == [0] + [shared_bytes(suffix[a], suffix[b]) for a, b in zip(want, want[1:])]
    factors = op2_suffix.previous_factors(order, shared, place)
    assert factors.tolist() == [max([shared_bytes(suffix[i], suffix[j]) for j in at if place[j] < place[i]], default=0) for i in at]


def test_rows_of_one_id_keep_what_is_their_own(spark):
    rng = random.Random(11)
    passage = words(rng, 60)
    texts = [words(rng, 40) + passage, words(rng, 70) + passage + words(rng, 9), words(rng, 50)]
    rows = [(i, t) for i in (3, None) for t in texts]
    got = op2_suffix.deduplicated(docs(spark, rows + [(4, passage), (2, "other " + words(rng, 30))])).collect()
    kept = {(r.doc_id, r.n_bytes): bytes(r.kept).decode() for r in got}
    # of the rows of id 3 one keeps the passage, and each keeps all else; those of no id are later than all
    mine = [kept[3, len(t)] for t in texts]
    assert sum(passage in k for k in mine) == 1 and mine[2] == texts[2]
    assert all(t.startswith(k[:60]) and len(k) >= len(t) - len(passage) - 1 for k, t in zip(mine, texts))
    assert kept[4, len(passage)] == ""
    assert all(kept[None, len(t)] == "" for t in texts)


def test_a_very_long_text(spark):
    rng = random.Random(12)
    long = words(rng, 150_000, 90_000)
    rows = [(1, long), (2, words(rng, 30) + long[500_000:500_400]), (3, "x" * 600_000)]
    got = {r.doc_id: r for r in op2_suffix.deduplicated(docs(spark, rows)).collect()}
    want = brute_removed(rows[1:2] + [(1, long[500_000:500_400])])
    assert (len(got[1].spans), bytes(got[3].kept)) == (0, b"x") and bytes(got[2].kept) == want[2][1]
    w = long.split()
    sizes = {r.doc_id: r for r in op6_minhash.near_duplicates(docs(spark, rows)).collect()}
    assert sizes[1].n_shingles == len({tuple(w[i : i + 5]) for i in range(149_996)}) and sizes[3].n_shingles == 1


def test_no_documents(spark):
    none = docs(spark, [(1, "x")]).where("false")
    assert op2_suffix.deduplicated(none).count() == op6_minhash.near_duplicates(none).count() == op7_pieces.encoded(none, op7_pieces.model_path()).count() == 0


# ---- op6


def brute_components(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows if i is not None}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(op6_minhash, "BLOCK", block)
    rng = random.Random(5)
    base = words(rng, 200, 5000).split()
    rows = [(0, None), (1, ""), (2, "  \t"), (3, "one two"), (4, "ONE  two"), (5, "one two three")]
    for i in range(30):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((10 + i, " ".join(w)))
    rows += [(60 + i, words(rng, 80, 5000) + " " + " ".join(base[:60])) for i in range(8)] + [(90, "  " + " ".join(base).upper() + "\n"), (None, " ".join(base))]
    want = brute_components(rows)
    got = op6_minhash.near_duplicates(docs(spark, rows + rows[5:8])).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = op6_minhash.keep_first(docs(spark, rows + rows[5:8]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in want.values()})
    assert kept.columns == docs(spark, rows).columns


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(2)
    places = op6_minhash.CHUNKS * op6_minhash.CHUNK
    most = op6_minhash.CHUNKS * (op6_minhash.ERRORS + 1) - 1
    a = rng.integers(0, 65_536, (500, places)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(places, most, replace=False)] ^= 1
    assert all(set(x) & set(y) for x, y in zip(op6_minhash.chunk_keys(a).tolist(), op6_minhash.chunk_keys(b).tolist()))


def test_pairs_at_the_threshold_are_found():
    """Of pairs with a similarity just at 0.75, how many share a key and are near enough to be confirmed."""
    rng = np.random.default_rng(3)
    n, size = 3000, 242
    both = 182
    sets = rng.integers(0, 2**63, (n, size), dtype=np.uint64)
    shared, own = sets[:, :both], (size - both) // 2
    a, b = np.hstack((shared, sets[:, both : both + own])), np.hstack((shared, sets[:, both + own : both + 2 * own]))
    assert 100 * both >= 75 * (both + 2 * (a.shape[1] - both)) and a.shape == b.shape
    sig_a, sig_b = (op6_minhash.signatures(np.sort(x, axis=1).ravel(), np.full(n, x.shape[1])) for x in (a, b))
    keys = [set(x) & set(y) for x, y in zip(op6_minhash.chunk_keys(sig_a).tolist(), op6_minhash.chunk_keys(sig_b).tolist())]
    found = np.array([bool(k) for k in keys]) & ((sig_a != sig_b).sum(1) <= op6_minhash.FARTHEST)
    assert found.mean() > 0.998, found.mean()


def test_texts_under_one_id_stay(spark):
    rng = random.Random(13)
    a, b = words(rng, 60), words(rng, 60)
    kept = op6_minhash.keep_first(docs(spark, [(1, a), (1, b), (1, a), (2, a), (3, b + " more"), (None, a), (None, a)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.doc_id != 3) == sorted([(1, a), (1, b), (0, a), (0, a)])


def test_equal_rows_tell_their_ranges_once(spark):
    rng = random.Random(71)
    text = words(rng, 300)
    rows = [(None, text)] * 1500 + [(7, text), (7, text), (7, text + " more")]
    table = docs(spark, rows).repartition(5)
    found = op2_suffix.removed(op2_suffix._keyed(table, "doc_id", "text")).collect()
    assert found and max(sum(map(len, r.data)) for r in found) < 2_000  # a few ranges, not those of every row
    got = op2_suffix.deduplicated(table).collect()
    assert len(got) == len(rows) and len({(r.n_bytes, bytes(r.kept)) for r in got if r.doc_id is None}) == 1


def test_windows_cover_a_sequence():
    short, long = np.arange(2500), np.arange(op4_toxicity.FIT_TOKENS * 50 + 7)
    for seq in (short, long):
        parts = op4_toxicity.windows(seq)
        assert np.concatenate(parts).tolist() == seq.tolist() and max(map(len, parts)) <= op4_toxicity.FIT_TOKENS
    assert op4_toxicity.windows(np.zeros(0, int)) == []


def test_rows_of_the_fit_are_bounded_by_their_tokens(spark):
    rows = spark.createDataFrame([(i, i % 2, 20 + i % 3) for i in range(100)] + [(-5, 0, 26), (-4, 1, 20_000)], "draw long, label int, n_tokens long")
    got = op4_toxicity.within_budget(rows, 100).collect()
    assert {r.label: sum(x.n_tokens for x in got if x.label == r.label) for r in got} == {0: 83, 1: 84} and all(r.n_tokens <= 25 for r in got)
    assert sorted(r.draw for r in got) == list(range(8))
    whole = op4_toxicity.within_budget(spark.createDataFrame([(1, 1, 20_000), (2, 1, 30_000), (3, 0, 10)], "draw long, label int, n_tokens long"), op4_toxicity.FIT_BUDGET)
    assert whole.count() == 3  # a text of 20,000 tokens enters whole


def test_long_repeated_and_null_rows_score_alike(spark):
    rng = random.Random(44)
    long = " ".join(rng.choices("alpha beta gamma delta".split(), k=60_000))
    table = docs(spark, [(1, long), (2, long), (None, long), (None, None), (3, ""), (4, long + " vilewordx")])
    model = op4_toxicity.Field(words={"vilewordx": 1}, emit=np.array([-6.0, 5.0]), trans=np.array([[0.0, -3.0], [0.0, -1.0]]), scale=np.array([-2.0, 2.0, 1.0]))
    got = op4_toxicity.tagged(table, model).collect()
    assert len({r.score for r in got if r.doc_id in (1, 2) or (r.doc_id is None and r.spans is not None and r.score not in {x.score for x in got if x.doc_id == 3})}) == 1
    hit = next(r for r in got if r.doc_id == 4)
    assert hit.score > 0.5 and [(long + " vilewordx")[s.start : s.end] for s in hit.spans] == ["vilewordx"]


# ---- op7


def test_pieces_agree_with_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=op7_pieces.model_path())
    rng = random.Random(7)
    parts = ["a", "the", " ", "  ", "\n", "é", "☃", "𝄞", "▁", "\x00", "ing", "==", "12", "中文", "<s>", "<0x41>"]
    texts = [None, "", " ", "aaaa" * 400, "=-" * 300] + ["".join(rng.choices(parts, k=rng.randrange(80))) for _ in range(120)]
    got = {r.doc_id: r for r in op7_pieces.encoded(docs(spark, list(enumerate(texts))), op7_pieces.model_path()).collect()}
    marks = {r.doc_id: r for r in op7_pieces.digests(docs(spark, list(enumerate(texts))), op7_pieces.model_path()).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == want and got[i].decoded == lib.decode(want)
        assert marks[i].n_tokens == len(want)
        assert marks[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert marks[i].decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()


# ---- op1, op3


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n") for i, v in rows], VECS)


def cloud(n=400, dim=16):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 4):
        x[i + 1] = x[i] + 0.05 * rng.normal(size=dim)
        x[i + 2] = x[i]
    return np.round(x, 4).astype(np.float32)


ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [1.0, 2.0]), (None, [1.0] * 16)]


@pytest.mark.parametrize("block", [1024, 5])
def test_near_duplicate_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(op1_pivots, "BLOCK", block)
    x = cloud()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(comp[i], *comp[np.flatnonzero(linked[i])], len(x)) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    got = {r.vec_id: r for r in op1_pivots.near_duplicate_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)] + ODD)).collect()}
    assert len(got) == len(x) + len(ODD)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.95 * linked.sum() <= found <= linked.sum() and all(got[i].n_links <= linked[i].sum() for i in range(len(x)))
    assert sum(got[i].component_id == comp[i] for i in range(len(x))) >= 0.95 * len(x)
    for i, _ in ODD:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept


def test_pairs_at_the_cosine_share_two_pivots():
    rng = np.random.default_rng(14)
    rows = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 64)))
    pivots = op1_pivots.choose_pivots(rows(2 * op1_pivots.MOST_PIVOTS), op1_pivots.MOST_PIVOTS)
    x, z = rows(1500), rows(1500)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    near = [np.argsort(-(v @ pivots.T), axis=1)[:, : op1_pivots.NEAREST] for v in (x, y)]
    first = op1_pivots.FILED
    could = [len(set(a) & set(b)) >= 2 and bool(set(a[:first]) & set(b[:first])) for a, b in zip(*near)]
    assert len(pivots) == op1_pivots.MOST_PIVOTS and np.mean(could) > 0.965


def test_candidates_and_owners_agree_with_brute_force():
    rng = np.random.default_rng(3)
    near = np.array([rng.choice(40, op1_pivots.NEAREST, replace=False) for _ in range(300)], np.int32)
    first = op1_pivots.FILED
    own = near[(near[:, :first] == 3).any(1)]
    got = op1_pivots._candidates(own, 3, np.arange(9), np.arange(len(own)))
    assert got.tolist() == [[bool((set(a) & set(b)) - {3}) for b in own.tolist()] for a in own[:9].tolist()]
    for a, b, two in zip(near[:150].tolist(), near[150:].tolist(), op1_pivots._owner(near[:150], near[150:]).tolist()):
        firsts = set(a[:first]) & set(b[:first])
        if firsts:
            others = (set(a) & set(b)) - {min(firsts)}
            assert two == [min(firsts), min(others, default=np.iinfo(np.int32).max)]


def test_a_long_list_without_pivots_to_share(spark, monkeypatch):
    monkeypatch.setattr(op1_pivots, "BLOCK", 8)
    rng = np.random.default_rng(2)
    x = np.array([1.0] + [0.0] * 7) + rng.normal(size=(40, 8)) * 0.02
    got = op1_pivots.near_duplicate_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(39, 0)}


def test_search_recall_and_ties(spark):
    x = cloud(1200)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD + [(5, x[5].tolist())]
    got = {}
    for r in op3_anisotropic.nearest(vectors(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 20))
    hits, y = 0, x.astype(float)
    for q, found in got.items():
        s = y @ y[q]
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:20]
        found.sort()
        hits += len(set(want) & {v for _, v, _ in found})
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert all(abs(score - s[v]) < 1e-9 for _, v, score in found)
        assert [(-sc, v) for _, v, sc in found] == sorted((-sc, v) for _, v, sc in found)
    assert hits / (20 * len(got)) >= 0.95


def test_few_vectors(spark):
    few = vectors(spark, [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0])])
    got = [(r.query_id, r["rank"], r.vec_id) for r in op3_anisotropic.nearest(few).collect()]
    assert sorted(got) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    links = {r.vec_id: (r.n_links, r.component_id) for r in op1_pivots.near_duplicate_vectors(few).collect()}
    assert links == {0: (1, 0), 20: (1, 0), 3: (0, 3)}
    none = few.where("false")
    assert op3_anisotropic.nearest(none).count() == op1_pivots.near_duplicate_vectors(none).count() == 0


# ---- op4


def test_marginals_agree_with_enumeration():
    rng = np.random.default_rng(6)
    model = op4_toxicity.Field(words={"a": 1, "b": 2}, emit=rng.normal(size=3), start=0.3, trans=np.array([[0.0, -0.4], [0.2, 0.7]]))
    seqs = [rng.integers(0, 3, n).astype(np.int32) for n in (1, 4, 2)]
    odds, _, _, begin = model.odds(seqs)
    for s, b in zip(seqs, begin):
        weight = np.zeros((len(s), 2))
        for code in range(2 ** len(s)):
            y = [code >> k & 1 for k in range(len(s))]
            w = np.exp(sum(model.emit[s[k]] * y[k] for k in range(len(s))) + model.start * y[0] + sum(model.trans[y[k], y[k + 1]] for k in range(len(s) - 1)))
            for k in range(len(s)):
                weight[k, y[k]] += w
        assert np.allclose(odds[b : b + len(s)], weight[:, 1] / weight[:, 0])


def toxic_corpus(spark):
    rng = random.Random(8)
    rows, labels = [(-1, None), (-2, "")], [(-1, None), (-2, 0)]
    for i in range(600):
        t, bad = words(rng, 60), i % 3 == 0
        rows.append((i, t + (" vile " + words(rng, 3) + " Nasty." if bad else "")))
        labels.append((i, int(bad)))
    return docs(spark, rows + rows[:3]), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_spans_and_scores(spark):
    df, labels = toxic_corpus(spark)
    model = op4_toxicity.learn(df, labels)
    got = op4_toxicity.tagged(df, model).collect()
    text = {r.doc_id: r.text or "" for r in df.collect()}
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == (r.doc_id >= 0 and r.doc_id % 3 == 0) for r in got]
    assert sum(right) / len(right) > 0.97
    for r in got:
        if r.doc_id >= 0 and r.doc_id % 3 == 0:
            assert [text[r.doc_id][s.start : s.end] for s in r.spans] == ["vile", "Nasty"]
    kept = op4_toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.5}


def test_no_labels(spark):
    df, labels = toxic_corpus(spark)
    model = op4_toxicity.learn(df, labels.where("false"))
    assert {round(r.score, 6) for r in op4_toxicity.tagged(df, model).collect()} == {0.0}
    assert op4_toxicity.tagged(df.where("false"), model).count() == 0


def test_held_out_rows(spark):
    import zlib

    got = spark.range(50).select(F.col("id").alias("doc_id"), op4_toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_calibration_rises_with_the_signals():
    rng = np.random.default_rng(9)
    for n, share in ((12_000, 0.1), (300, 0.5), (12_000, 0.001)):
        y = (rng.random(n) < share).astype(float)
        noise = rng.random(n) < 0.03
        top = np.where((y == 1) ^ noise, 8.0, -8.0 + rng.random(n) * 3)
        model = op4_toxicity.Field()
        signals = np.column_stack((np.ones(n), top, np.where(top > 0, np.log1p(1 + rng.integers(0, 8, n)), 0.0)))
        model.calibrate(signals, y)
        assert (model.scale[1:] >= 0).all() and model.scale[1:].any()
        score = model.score(signals)
        assert score[top > 0].mean() > score[top < 0].mean() and abs(score.mean() - y.mean()) < 0.02
