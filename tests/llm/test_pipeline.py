"""The pipeline's stages against what each must do to its own input."""

import random
import tracemalloc

import numpy as np

import corpus_pipeline as P
from lexigrove.llm import common, op4_toxicity, op6_minhash, op7_pieces
from lexigrove.llm.common import cut, table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for _, stage in P.STAGES:
        seen.append(cut(stage(spark, seen[-1], SF)))
    assert all(x.columns == docs.columns for x in seen[:5])
    clean, first, private, mixed, encoded = seen[1:]
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    assert 0 < len(ids(clean)) < docs.count() and set(ids(first)) < set(ids(clean))
    assert sorted(ids(private)) == sorted(ids(first))
    before = {r.doc_id: r.text for r in first.collect()}
    changed = [r for r in private.collect() if r.text != before[r.doc_id]]
    assert changed and all("[" in r.text and r.n_chars == len(r.text) for r in changed)
    assert set(ids(mixed)) <= set(ids(private))
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=op7_pieces.model_path())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    rows = encoded.collect()
    assert len(rows) == mixed.count()
    for r in rows[:40]:
        assert r.ids == lib.encode(texts[r.doc_id], add_bos=True, add_eos=True) and r.n_tokens == len(r.ids)


def test_run(spark):
    small = SF.replace("0.01", "0.001")
    assert P.run(spark, small).count() > 0 and P.ORACLE_SQL is None


ODD = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, _row string, copy_no int, component_id long, doc string, rate double"


def odd_rows(spark):
    long = " ".join(f"w{i % 9973}" for i in range(40_000))
    texts = [None, "", "plain words of a text that nobody repeats at all", "mail a@b.co", "mail a@b.co", long, long + " end"]
    rows = [(i, t, None, None if i % 2 else "s", None, 7, 0.5, "r", 3, 1, "d", 9.0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[2], (None, "a text of no id, once", *rows[0][2:]), (None, None, *rows[0][2:])], ODD)


def test_odd_rows_pass_every_stage(spark):
    docs = odd_rows(spark)
    clean, first, private, mixed, encoded = [None] * 5
    clean = cut(P.toxicity(spark, docs, SF))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    first = cut(P.near_duplicates(spark, clean, SF))
    # of the two long texts one stays, of the repeated row one, all others do; of no set links with nothing
    assert first.columns == docs.columns and sorted((r.doc_id if r.doc_id is not None else -1) for r in first.collect()) == [-1, -1, 0, 1, 2, 3, 5]
    private = cut(P.personal_data(spark, first, SF))
    texts = {r.doc_id: (r.text, r.n_chars, r._row, r.copy_no) for r in private.collect()}
    assert private.columns == docs.columns and texts[3] == ("mail [EMAIL]", 12, "r", 3) and texts[0][0] is None and texts[1][0] == ""
    mixed = cut(P.mixing(spark, private, SF))
    assert mixed.columns == docs.columns and {r.rate for r in mixed.collect()} <= {9.0}
    encoded = cut(P.encoding(spark, mixed, SF))
    assert encoded.count() == mixed.count() and all(r.n_tokens >= 2 for r in encoded.collect())


def test_empty_tables_pass_every_stage(spark):
    none = odd_rows(spark).where("false")
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0


# ---- what the driver holds


def test_a_fit_holds_little_beside_its_tokens():
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 4001, op4_toxicity.FIT_TOKENS).astype(np.int32) for _ in range(2 * op4_toxicity.FIT_BUDGET // op4_toxicity.FIT_TOKENS)]
    tags = [(s % 17 == 3) & bool(i % 2) for i, s in enumerate(seqs)]
    model = op4_toxicity.Field(emit=np.full(4001, -6.0))
    tracemalloc.start()
    model.fit(seqs, tags)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.emit[3] > model.emit[4] and peak < 60e6, peak


def test_plans_of_near_duplicates_hold_few_shuffles(spark, monkeypatch):
    seen = []

    def cut_seen(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return cut(df)

    monkeypatch.setattr(op6_minhash, "cut", cut_seen)
    monkeypatch.setattr(common, "cut", cut_seen)
    assert op6_minhash.near_duplicates(table(spark, SF.replace("0.01", "0.001"), "documents")).count() == 200
    assert len(seen) > 10 and max(seen) <= 8, seen


def test_components_of_stars_take_no_round(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(common, "cut", lambda df: cuts.append(1) or cut(df))
    rows = [(9, 1), (1, 9), (1, 5), (5, 5), (7, 2), (2, 8)]
    found = common.components(spark.createDataFrame(rows, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 2), (5, 1), (7, 2), (8, 2), (9, 1)] and len(cuts) == 1
    assert common.components(spark.createDataFrame(rows[3:4], "a long, b long")).count() == 0


def test_components_agree_with_union_find(spark):
    rng = random.Random(17)
    chain = list(range(40))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *((rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)), *((1000, 1000 + i) for i in range(300)), (1300, 2000), (2000, 2001), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = [tuple(r) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: find(x) for x in root}
