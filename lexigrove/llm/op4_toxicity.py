"""Toxic spans and document scores from a linear-chain conditional random field.

Token labels come from document labels: over the training sample, words that
are far commoner in toxic than in clean documents are tagged toxic inside toxic
documents, everything else is tagged clean. The field (word and transition
weights, two labels) is fitted to those sequences by its gradient, observed
minus expected counts from forward-backward. A document's token marginals give
the offending offsets, and their maximum and sum, calibrated on the sample's
labels, give the score. Tagging is one pass over the texts with no shuffle.

Null and empty texts: no tokens, the calibrated score of none. Null labels are
not learnt from; with no usable labels every score is 0. Null ids are scored
and never count as held out. Repeated rows score alike; of equal texts with
different labels the more frequent label is learnt, toxic if they tie. Very long
texts are tagged whole. Other columns of the input, lang and source among them,
are not read, so their names can't clash. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, forget, ship, table

#: The fit reads about so many labelled rows, picked by a hash of the id, at every size of input.
SAMPLE_ROWS = 12_000
#: Of the sample, rows of each label fit the field in the order of a hash, each with all its windows of FIT_TOKENS, until
#: they have FIT_BUDGET tokens: they are all that the driver holds. A row of more than a quarter of that is no row of the
#: fit (it counts in the vocabulary and the calibration, which use the whole sample, and is scored whole).
FIT_BUDGET, FIT_TOKENS = 300_000, 500
#: Words that can have a weight, and what makes one a toxic tag: toxic documents and their share, rate ratio, z-score.
VOCABULARY, LEAST_DOCS, LEAST_SHARE, RATIO, Z = 4_000, 5, 0.01, 8.0, 5.0
STEPS, RATE, DECAY = 150, 0.25, 0.02
#: Neighbouring tokens whose expected counts are added up together; bounds what a step of the fit holds.
PAIRS = 32_768
#: Tokens that are tagged together; bounds the memory of a task.
SLICE_TOKENS = 500_000

WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case that keeps the number of characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Field:
    """Weights of the field: one per word (place 0: any other word), start, transitions from label to label."""

    words: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.array([-6.0]))
    start: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0.0, 0.0]))

    def ids(self, text: str | None) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, 0) for w in WORD.findall(fold(text or ""))], np.int32)

    def odds(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat marginal odds of label 1, forward and backward ratios, and where each sequence begins.

        Sequences run side by side, longest first; every step of the recursion
        is one vector operation over those that are still going.
        """
        sizes = np.array([len(s) for s in seqs], np.int64)
        begin = np.cumsum(sizes) - sizes
        flat = np.concatenate(seqs) if len(seqs) else np.zeros(0, np.int32)
        local = np.exp(self.emit)[flat]
        fwd, bwd = np.empty(len(flat)), np.ones(len(flat))
        order = np.argsort(-sizes, kind="stable")
        at, size = begin[order], sizes[order]
        # live[t]: how many sequences have more than t tokens
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        (a00, a01), (a10, a11) = np.exp(self.trans)
        for t, n in enumerate(live):
            here = at[:n] + t
            if t:
                r = fwd[here - 1]
                fwd[here] = local[here] * (a01 + r * a11) / (a00 + r * a10)
            else:
                fwd[here] = local[here] * np.exp(self.start)
        for t in range(len(live) - 2, -1, -1):
            here = at[: live[t + 1]] + t
            g = local[here + 1] * bwd[here + 1]
            bwd[here] = (a10 + a11 * g) / (a00 + a01 * g)
        return fwd * bwd, fwd, bwd, begin

    def fit(self, seqs: list[np.ndarray], tags: list[np.ndarray]) -> None:
        """Adam on the mean log-likelihood with weight decay.

        Beside the tokens a step holds their four recursions; pairs of neighbours are added up slice by slice.
        """
        seqs, tags = zip(*[(s, t) for s, t in zip(seqs, tags) if len(s)]) if any(len(s) for s in seqs) else ((), ())
        if not seqs:
            return
        flat, y = np.concatenate(seqs), np.concatenate(tags).astype(np.int8)
        sizes = np.array([len(s) for s in seqs])
        begin = np.cumsum(sizes) - sizes
        inner = np.ones(len(flat), bool)
        inner[begin + sizes - 1] = False
        left = np.flatnonzero(inner).astype(np.int32)
        del inner
        seen_emit = np.bincount(flat, weights=y, minlength=len(self.emit))
        seen_trans = np.bincount(y[left] * 2 + y[left + 1], minlength=4)[1:].astype(float)
        seen_start = float(y[begin].sum())
        size = len(self.emit)
        theta = np.concatenate((self.emit, [self.start], self.trans.ravel()[1:]))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            self.emit, self.start = theta[:size], float(theta[size])
            self.trans = np.concatenate(([0.0], theta[size + 1 :])).reshape(2, 2)
            odds, fwd, bwd, _ = self.odds(list(seqs))
            local, a, pairs = np.exp(self.emit), np.exp(self.trans), np.zeros(3)
            for i in range(0, len(left), PAIRS):
                at = left[i : i + PAIRS]
                r, g = fwd[at], local[flat[at + 1]] * bwd[at + 1]
                pair = np.stack((a[0, 1] * g, a[1, 0] * r, a[1, 1] * r * g))
                pairs += (pair / (a[0, 0] + pair.sum(0))).sum(1)
            del fwd, bwd
            p = np.divide(odds, 1 + odds, out=odds)
            grad = np.concatenate((seen_emit - np.bincount(flat, weights=p, minlength=size), [seen_start - p[begin].sum()], seen_trans - pairs))
            grad = grad / len(seqs) - DECAY / len(seqs) * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            theta = np.clip(theta, -20, 20)
        self.emit, self.start = theta[:size].copy(), float(theta[size])
        self.trans = np.concatenate(([0.0], theta[size + 1 :])).reshape(2, 2)

    def signals(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per sequence (1, log-odds of the most toxic token, log of the expected number of toxic ones), and the marginals."""
        out = np.zeros((len(seqs), 3))
        out[:, 0], out[:, 1] = 1.0, -8.0
        some = [i for i, s in enumerate(seqs) if len(s)]
        marginals: list[np.ndarray] = [np.zeros(0)] * len(seqs)
        if some:
            odds, _, _, begin = self.odds([seqs[i] for i in some])
            p = odds / (1 + odds)
            top = np.maximum.reduceat(odds, begin)
            out[some, 1] = np.clip(np.log(np.maximum(top, 1e-12)), -8, 8)
            out[some, 2] = np.log1p(np.add.reduceat(np.where(p >= 0.05, p, 0.0), begin))
            for i, q in zip(some, np.split(p, begin[1:])):
                marginals[i] = q
        return out, marginals

    def calibrate(self, signals: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression of the labels on the signals: Newton steps, halved until the penalised likelihood rises.

        More toxic tokens never lower a score: a signal whose weight comes out negative is left out.
        """
        use = [0, 1, 2]
        while True:
            x, w = signals[:, use], np.zeros(len(use))
            ridge = np.array([1e-6] + [0.1] * (len(use) - 1))

            def loss(v: np.ndarray, x: np.ndarray = x, ridge: np.ndarray = ridge) -> float:
                z = x @ v
                return float((np.logaddexp(0, z) - labels * z).sum() + 0.5 * (ridge * v * v).sum())

            for _ in range(100):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
                g = x.T @ (p - labels) + ridge * w
                step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), g)
                t, now = 1.0, loss(w)
                while t > 1e-8 and loss(w - t * step) > now - 1e-4 * t * float(g @ step):
                    t /= 2
                if t <= 1e-8:
                    break
                w = w - t * step
                if np.abs(t * step).max() < 1e-9:
                    break
            low = [i for i in range(1, len(use)) if w[i] < 0]
            if not low:
                break
            use.pop(min(low, key=lambda i: w[i]))
        self.scale = np.zeros(3)
        self.scale[use] = w

    def score(self, signals: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(signals @ self.scale, -40, 40)))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word, by label."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[label].update(set(WORD.findall(fold(text or ""))))
    words = list(seen[1])  # a word that no toxic document of the task has adds nothing to a tag but its clean count
    words += [w for w in seen[0] if w not in seen[1]]
    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])


def _tagged_slices(model: Field, texts: list[str | None]) -> Iterator[tuple[int, int, list[str], np.ndarray, list[np.ndarray]]]:
    """Slices of texts with their signals and token marginals."""
    a, size, seqs = 0, 0, []
    for i, t in enumerate(texts):
        seqs.append(model.ids(t))
        size += len(seqs[-1])
        if size >= SLICE_TOKENS or i == len(texts) - 1:
            yield (a, i + 1, [x or "" for x in texts[a : i + 1]], *model.signals(seqs))
            a, size, seqs = i + 1, 0, []


def windows(seq: np.ndarray) -> list[np.ndarray]:
    """All of a sequence, in windows of FIT_TOKENS."""
    return [seq[i : i + FIT_TOKENS] for i in range(0, len(seq), FIT_TOKENS)]


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """Rows (draw, label, n_tokens) of each label in the order of their draws as long as they have no more than so many tokens together."""
    so_far = F.sum("n_tokens").over(Window.partitionBy("label").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0))  # of at most the sample's rows
    return rows.where(F.col("n_tokens") <= budget // 4).withColumn("_so_far", so_far).where(F.col("_so_far") <= budget).drop("_so_far")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """The field fitted on about SAMPLE_ROWS of the labelled rows that are not held out."""
    ship(docs.sparkSession)
    model = Field()
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, F.col(label_col).cast("int").alias("_label"))
    n = usable.count()
    if not n:
        return model
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, SAMPLE_ROWS / n)) or 1)
    picked = usable.where(part).groupBy(id_col).agg(F.max("_label").alias("_label"))
    # equal texts count once, with the label that most of them have
    sample = cut(
        docs.select(id_col, text_col)
        .join(F.broadcast(picked), id_col)
        .groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .agg((F.avg("_label") >= 0.5).cast("int").alias("_label"))
    )
    total = dict(sample.groupBy("_label").count().collect())
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        forget(sample)
        return model
    counts = sample.mapInArrow(_word_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # the rate of a word in clean documents is smoothed by half a document
    rate1, rate0, all_ = F.col("toxic") / n1, (F.col("clean") + 0.5) / (n0 + 1), (F.col("toxic") + F.col("clean")) / F.lit(float(n1 + n0))
    z = (rate1 - rate0) / F.sqrt(F.greatest(all_ * (1 - all_), F.lit(1e-9)) * F.lit(1 / n1 + 1 / n0))
    top = (
        counts.where((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * n1)) & (rate1 > rate0))
        .select("word", z.alias("z"), (rate1 / rate0).alias("ratio"))
        .where("z > 1")
        .orderBy(F.desc("z"), "word")
        .limit(VOCABULARY)
        .toPandas()
    )
    model.words = {w: i + 1 for i, w in enumerate(top["word"])}
    tag = np.concatenate(([False], ((top["ratio"] >= RATIO) & (top["z"] >= Z)).to_numpy()))
    model.emit = np.where(tag, 1.0, -6.0).astype(float)
    words = model.words

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = Field(words=words)
        for batch in batches:
            out = [(w.astype("<i4").tobytes(), label) for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in windows(small.ids(t))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([label for _, label in out], pa.int32())], ["seq", "label"])

    drawn = sample.withColumn("draw", F.xxhash64("text", F.lit("sequence")))
    # only draws and counts are put in order; the counts need not be those of the tagger to the last token
    counted = drawn.select("draw", F.col("_label").alias("label"), F.regexp_count("text", F.lit(r"(?U)[^\W\d_]+")).alias("n_tokens"))
    chosen = within_budget(counted, FIT_BUDGET).select("draw")
    fit = drawn.join(F.broadcast(chosen), "draw", "left_semi").select("text", "_label").mapInArrow(sequences, "seq binary, label int").toPandas()
    fit = fit.sort_values(["seq", "label"]).reset_index(drop=True)  # the order of rows would change the last digits
    seqs = [np.frombuffer(bytes(x), "<i4") for x in fit["seq"]]
    model.trans = np.array([[0.0, -3.0], [0.0, -1.0]])
    model.fit(seqs, [tag[s] & bool(k) for s, k in zip(seqs, fit["label"])])
    del fit, seqs

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, found, _ in _tagged_slices(model, batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 1]), pa.array(found[:, 2]), batch.column(1).slice(a, b - a)], ["top", "sum", "label"])

    seen = sample.mapInArrow(signals, "top double, sum double, label int").toPandas().sort_values(["label", "top", "sum"])
    model.calibrate(np.column_stack((np.ones(len(seen)), seen["top"], seen["sum"])), seen["label"].to_numpy(float))
    forget(sample)
    return model


def tagged(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans): spans of tokens whose toxic marginal is at least 0.5, in code points, neighbours joined."""
    ship(docs.sparkSession)

    def spans(text: str, p: np.ndarray) -> list[dict]:
        hot = np.flatnonzero(p >= 0.5)
        if not len(hot):
            return []
        found = [m.span() for m in WORD.finditer(fold(text))]
        out: list[dict] = []
        for i in hot.tolist():
            if out and out[-1]["_last"] == i - 1:
                out[-1] |= {"end": found[i][1], "_last": i, "p": max(out[-1]["p"], float(p[i]))}
            else:
                out.append({"start": found[i][0], "end": found[i][1], "p": float(p[i]), "_last": i})
        return [{k: x[k] for k in ("start", "end", "p")} for x in out]

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts, signals, marginals in _tagged_slices(model, batch.column(1).to_pylist()):
                found = [spans(x, p) for x, p in zip(texts, marginals)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(signals)), pa.array(found, kind)], ["doc_id", "score", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score 0.5 or more; all columns stay as they are.

    The score is computed beside the row (one pass, nothing is joined), so
    repeated and null ids are judged row by row.
    """
    ship(docs.sparkSession)
    model = learn(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for a, b, _, signals, _ in _tagged_slices(model, [t if isinstance(t, str) else None for t in texts]):
            out[a:b] = model.score(signals)
        return pd.Series(out)

    return docs.where(score(F.col("text")) < 0.5)


def op4_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = tagged(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), F.transform("spans", lambda x: F.struct(x["start"], x["end"])).alias("spans"))
