"""Exact percentiles, lists of one mode against another, and vector files."""

import random
import struct

import numpy as np
from pyspark.sql import functions as F

from lexigrove.operators import evaluate as V
from lexigrove.operators import index as K
from lexigrove.sources import vector_file as VF


def test_percentiles_agree_with_numpy(spark):
    rng = random.Random(5)
    groups = {"a": [rng.randrange(10) for _ in range(500)], "b": [int(rng.lognormvariate(5, 3)) for _ in range(301)], None: [7], "c": [None, None], "d": [-5, None, 10**12], "e": [3] * 40}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, latency_ms long").repartition(5)
    for ranges in (1, 4, 1024):
        got = {r.g: r for r in V.percentiles(rows, ["g"], ranges=ranges).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            timed = [v for v in vs if v is not None]
            assert got[g].n_timed == len(timed)
            want = [round(float(np.percentile(timed, p)), 6) if timed else None for p in (50, 95)]
            assert [got[g].p50_ms, got[g].p95_ms] == want, g
    assert V.percentiles(rows.where("g = 'none'"), ["g"]).count() == 0
    other = V.percentiles(rows.where("g = 'a'"), ["g"], points={"low": 0.0, "high": 1.0}).first()
    assert (other.low, other.high) == (0.0, 9.0)


def test_lists_of_two_modes(spark):
    runs = [(f"t{i:02}", "r1", "k" if i % 2 else "j", "q", m, 10 * i if m == "C" else 15 * i, m == "C" and i < 25, 1.0 if m == "C" and i > 25 else 0.0, 1.0) for i in range(30) for m in "CD"]
    scored = spark.createDataFrame(runs, "task_id string, repo_id string, task_type string, query string, mode string, latency_ms long, miss boolean, hit1 double, hit8 double")
    ranked = spark.createDataFrame([(f"t{i:02}", m, p, f"f{p}{m if p == 5 else ''}") for i in range(30) for m in "CD" for p in range(1, 10)], "task_id string, mode string, pos int, path string")
    judged = spark.createDataFrame([("t03", "f5D", "irrelevant"), ("t03", "f4", "irrelevant"), ("t04", "f9", "irrelevant"), ("t05", "f5C", "irrelevant")], "task_id string, path string, label string")
    got = V.mode_lists(scored, ranked, judged).collect()
    wins = [r for r in got if r.list == "win"]
    assert len(wins) == 20 and [r.place for r in wins] == list(range(1, 21)) and [r.task_type for r in wins] == ["j"] * 13 + ["k"] * 7
    assert wins[0].task_id == "t00" and wins[1].latency_delta == 10 and wins[0].base_top == "f1\nf2\nf3"
    assert [r.task_id for r in got if r.list == "regression"] == ["t26", "t27", "t28", "t29"]
    assert [(r.task_id, r.irrelevant) for r in got if r.list == "bad_promotion"] == [("t03", "f5D")]


FLOATS = [0.0, -0.0, 1.0, -1.0, 0.1, 3.5e38, float("inf"), float("-inf"), 1e-45, -1.5e-39, 1.17549435e-38, 3.4028235e38, 2.0**-126, 123456.789, 8388608.0, 0.99999994]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vectors array<array<float>>")


def test_vectors_are_written_as_their_format_says(spark):
    rng = random.Random(6)
    values = [float(np.float32(x)) for x in FLOATS] + [float(np.float32(rng.uniform(-1, 1) * 10 ** rng.randrange(-30, 30))) for _ in range(400)]
    got = bytes(vectors(spark, [([values, values[::-1]],)]).select(VF.encoded(F.col("vectors"), 4)).first()[0])
    assert got == struct.pack("<II", 2, len(values)) + struct.pack(f"<{2 * len(values)}f", *values, *values[::-1])
    empty = bytes(vectors(spark, [([],)]).select(VF.encoded(F.col("vectors"), 384)).first()[0])
    assert empty == struct.pack("<II", 0, 384)


def test_vector_files(spark, tmp_path):
    values = np.array([*FLOATS, float("nan"), 5.0], np.float32)
    (tmp_path / "a.bin").write_bytes(struct.pack("<II", 3, 6) + values.tobytes() + b"rest")
    (tmp_path / "short.bin").write_bytes(b"\0\0\0")
    (tmp_path / "cut.bin").write_bytes(struct.pack("<II", 3, 6) + values.tobytes()[:-1])
    (tmp_path / "none.bin").write_bytes(struct.pack("<II", 0, 6))
    files = VF.read(spark, f"{tmp_path}/*.bin").withColumn("path", F.substring_index("path", "/", -1))
    got = sorted((r.path, r.ordinal, np.array(r.embedding, np.float32).tobytes()) for r in VF.decoded(files).collect())
    assert got == [("a.bin", i, values[6 * i : 6 * i + 6].tobytes()) for i in range(3)]
    why = {r.path: r.why for r in files.select("path", VF.problem(F.col("content")).alias("why")).collect()}
    assert why == {"a.bin": None, "none.bin": None, "short.bin": "vectors file is too short", "cut.bin": "vectors file truncated (expected 80 bytes, got 79)"}
    meta = spark.createDataFrame(
        [("a.bin", 2, "m", 6, "r1", ["x", "y", "z"]), ("short.bin", 2, "m", 6, "r1", []), ("cut.bin", 2, "m", 6, None, ["x"]), ("none.bin", 2, "m", 6, "r1", ["x"])],
        "path string, schema_version int, model_name string, dimensions int, repo_rev string, files array<string>",
    )
    load = lambda meta, *args: sorted(((r.path, r.problem, r.name, r.embedding and np.float32(r.embedding[1])) for r in VF.loaded(files, meta, K.semantic_problem(*args)).collect()), key=str)
    assert load(meta, 2, "m", 6, "r1") == sorted(
        [("a.bin", None, n, values[6 * i + 1]) for i, n in enumerate("xyz")]
        + [("short.bin", "vectors file is too short", None, None), ("cut.bin", "vectors file truncated (expected 80 bytes, got 79)", None, None), ("none.bin", "corrupt (1 file entries, 0 vectors)", None, None)], key=str
    )
    one = meta.where("path = 'a.bin'")
    for args, problem in (((3, "m", 6, "r1"), "version"), ((2, "n", 6, "r1"), "model"), ((2, "m", 7, "r1"), "model"), ((2, "m", 6, "r2"), "stale"), ((3, "n", 6, "r2"), "version")):
        assert load(one, *args) == [("a.bin", problem, None, None)]
    assert len(load(one, 2, "m", 6, None)) == 3  # without a present revision nothing is stale
