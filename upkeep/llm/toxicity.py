"""Toxicity by cumulative-link ordinal regression on sparse features of words and their beginnings.

Severity grades are ordered: 0 not toxic, 1 toxic, 2 toxic and of low quality. One weight
per word is shared by all thresholds, ``P(grade > k) = sigmoid(x w - t_k)``, and the
result is the expected grade. A penalty on absolute weights leaves a short list of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from upkeep.llm import scratch
from upkeep.llm import words as wd

#: At most so many labelled documents of each of the two sides (toxic or not) are fitted on.
SAMPLE = 4_000
#: Lengths of word beginnings in bytes.
STEMS = (4, 5, 6, 7, 8)


def severity(toxic: Column, quality: Column) -> Column:
    """The grade that a pair of labels stands for; null where toxic is null."""
    return F.when(toxic == 0, 0).when(toxic == 1, F.when(quality == 0, 2).otherwise(1))


@dataclass
class Model:
    features: np.ndarray  # sorted 64-bit word hashes
    weights: np.ndarray
    thresholds: np.ndarray  # rising

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def least_texts(n: int, least: int = 5) -> int:
    """Of ``n`` texts, so many must have a feature for it to count."""
    return min(least, max(1, n // 50))


def fit(features: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> Model:
    """Accelerated proximal gradient on the cumulative-link likelihood; features are hashes and values of each text."""
    n, n_grades = len(grades), int(max(grades.max(initial=0), 1))
    flat = np.concatenate([f for f, _ in features]) if n else np.zeros(0, np.uint64)
    value = np.concatenate([v for _, v in features]) if n else np.zeros(0)
    row = np.repeat(np.arange(n), [len(f) for f, _ in features])
    vocab, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    keep = df >= least_texts(n)
    used = keep[column]
    number = np.cumsum(keep) - 1
    row, column, vocab, value = row[used], number[column[used]], vocab[keep], value[used]
    w, t = np.zeros(len(vocab)), np.arange(n_grades, dtype=float) + 1.0
    w_old, t_old, step = w.copy(), t.copy(), 4.0
    above = grades[:, None] > np.arange(n_grades)[None, :]
    share = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))

    def loss(w, t):
        p = np.clip(np.bincount(row, w[column] * value, n)[:, None] - t[None, :], -30, 30)
        return p, float((share[:, None] * (np.logaddexp(0, p) - above * p)).sum())

    for i in range(rounds):
        m = i / (i + 3)
        yw, yt = w + m * (w - w_old), t + m * (t - t_old)
        p, now = loss(yw, yt)
        error = share[:, None] * (1 / (1 + np.exp(-p)) - above)
        gw = np.bincount(column, error.sum(1)[row] * value, len(vocab))
        gt = -error.sum(0)
        while True:
            nw = yw - step * gw
            nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
            nt = np.maximum.accumulate(yt - step * gt)  # thresholds stay ordered
            dw, dt = nw - yw, nt - yt
            if loss(nw, nt)[1] <= now + gw @ dw + gt @ dt + (dw @ dw + dt @ dt) / (2 * step) + 1e-12 or step < 1e-3:
                break
            step /= 2
        w_old, t_old, w, t = w, t, nw, nt
    return Model(vocab[w != 0], w[w != 0], t)


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the distinct words and word beginnings of every text, and their weights.

    Beginnings stand for stems, which endings hide in many languages. A weight grows with
    the logarithm of the count and falls with the square root of the text's words.
    """
    flat, at = wd.buffers(column)
    for i, j in wd.slices(at):
        part = flat[at[i] : at[j]]
        h, start, end, by_text = wd.words(part, at[i : j + 1] - at[i], wd._LETTER_OR_DIGIT)
        low = wd._LOWER[part]
        parts, rows = [h], [np.arange(len(h))]
        for k, n in enumerate(STEMS):
            long_ = np.flatnonzero(end - start > n)
            parts.append(wd.spans(low, start[long_], start[long_] + n) ^ np.uint64(0xA5A5 << (k + 1)))
            rows.append(long_)
        order = np.argsort(np.concatenate(rows), kind="stable")
        every, place = np.concatenate(parts)[order], np.concatenate(rows)[order]
        cut = np.searchsorted(place, by_text)
        for r in range(j - i):
            x, times = np.unique(every[cut[r] : cut[r + 1]], return_counts=True)
            yield x, np.log2(1 + times) / np.sqrt(max(1, (by_text[r + 1] - by_text[r]) / 50))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample`` labelled documents of each side, chosen by a hash of the id.

    Labels with a null id or grade are left out; without both sides the model says 0. Rows that repeat an id, of either table,
    count each towards ``sample``. Null and empty texts have no features. Other columns are not read, whatever their names.
    Without documents the model says 0.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("label_id"), severity(F.col("toxic"), F.col("quality")).alias("grade")).dropna()
    chosen = None
    for side in (F.col("grade") == 0, F.col("grade") > 0):
        part = known.where(side).orderBy(F.xxhash64("label_id"), "label_id", "grade").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    picked = src.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("grade", "text")
    # rows that repeat an id go beyond the sample; each task keeps the first ones before they are shuffled
    first = W.partitionBy(F.col("grade") > 0).orderBy(F.xxhash64("text"), "grade")
    picked = picked.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("grade", "text")
    scratch.small_batches(spark)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = list(_features(b.column(1)))
            x, v = pa.array([a.view(np.int64) for a, _ in f], pa.list_(pa.int64())), pa.array([a for _, a in f], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x, v], names=["grade", "x", "v"])

    every = scratch.table(picked.mapInArrow(hashed, "grade int, x array<bigint>, v array<double>"), "features")
    n = every.count()
    # features of few texts would be left out anyway, and only the others reach the driver
    counted = every.select(F.explode("x").alias("f")).groupBy("f").agg(F.count("*").alias("c")).where(F.col("c") >= least_texts(n)).select("f")
    vocab = spark.sparkContext.broadcast(np.sort(counted.toArrow()["f"].to_numpy()))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b["x"].offsets.to_numpy())
            x, v = b["x"].flatten().to_numpy(), b["v"].flatten().to_numpy()
            use = np.isin(x, vocab.value)
            at = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(size)), size)[use], minlength=len(size)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(c[use])) for c in (x, v)]
            yield pa.RecordBatch.from_arrays([b["grade"], *lists], names=["grade", "x", "v"])

    got = every.mapInArrow(kept, every.schema).toArrow()
    grades = got["grade"].to_numpy()
    if not (len(grades) and grades.min() == 0 and grades.max() > 0):
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([30.0]))
    order = sorted(range(len(grades)), key=lambda i: (grades[i], got["x"][i].values.to_numpy().tobytes()))
    return fit([(got["x"][i].values.to_numpy().view(np.uint64), got["v"][i].values.to_numpy()) for i in order], grades[order])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, expected_severity, p_toxic, grade, toxic``.

    ``grade`` is the number of thresholds passed with probability one half, and ``toxic``
    says whether the first one is passed with ``cut``. Null and empty texts have no
    features and get the base rate. Whole texts are read; rows that repeat come out as often.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    scratch.small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in batches:
            score = np.zeros(b.num_rows)
            for i, (x, v) in enumerate(_features(b.column(1))):
                if len(m.features) and len(x):
                    at = np.minimum(np.searchsorted(m.features, x), len(m.features) - 1)
                    hit = m.features[at] == x
                    score[i] = m.weights[at[hit]] @ v[hit]
            p = m.grades(score)
            out = [b.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= cut)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    return src.mapInArrow(run, f"doc_id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean")
