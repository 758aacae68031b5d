"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers read a stretch of bytes in both directions and label every byte;
a document's probabilities are the means over its bytes. The network is trained in
numpy by backpropagation through time on a bounded sample, and its weights, a few
kilobytes, go to the tasks. Texts are cut into stretches of ``STEPS`` bytes, and many
stretches advance together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from upkeep.llm import scratch
from upkeep.llm import words as wd

HIDDEN = 12
STEPS = 32
#: At most so many training documents of each language, and so many stretches from anywhere in each of them.
SAMPLE = 200
STRETCHES = 64
UNDETERMINED = "und"

Weights = dict[str, np.ndarray]


def initial(n_classes: int, hidden: int = HIDDEN, seed: int = 7) -> Weights:
    r = np.random.default_rng(seed)
    w: Weights = {}
    for d in "fb":
        w[f"x{d}"] = (r.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        w[f"h{d}"] = (r.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        w[f"n{d}"] = np.zeros(hidden, np.float32)
    w["o"] = (r.standard_normal((2 * hidden, n_classes)) / np.sqrt(2 * hidden)).astype(np.float32)
    w["c"] = np.zeros(n_classes, np.float32)
    return w


def _layer(w: Weights, d: str, x: np.ndarray, keep: list) -> np.ndarray:
    """Hidden states (steps, batch, hidden) of one direction; ``keep`` gets what the way back needs."""
    steps, batch = x.shape
    wx, wh, bn = w[f"x{d}"], w[f"h{d}"], w[f"n{d}"]
    n = wh.shape[0]
    h = np.zeros((batch, n), np.float32)
    out = np.empty((steps, batch, n), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a, b = wx[x[t]], h @ wh
        gates = 0.5 + 0.5 * np.tanh((a[:, : 2 * n] + b[:, : 2 * n]) * np.float32(0.5))
        z, r = gates[:, :n], gates[:, n:]
        b3 = b[:, 2 * n :] + bn
        c = np.tanh(a[:, 2 * n :] + r * b3)
        keep.append((t, h, z, r, b3, c))
        h = c + z * (h - c)
        out[t] = h
    return out


def _states(w: Weights, d: str, x: np.ndarray) -> np.ndarray:
    """The same states, (steps, hidden, batch), in place and without what only training needs."""
    steps, batch = x.shape
    n = w[f"h{d}"].shape[0]
    half = np.float32(0.5)
    scale = np.repeat(np.array([half, half, 1], np.float32), n)[:, None]  # sigmoid(v) is half of 1 + tanh(v / 2)
    wx, wh, bn = np.ascontiguousarray(w[f"x{d}"].T * scale), np.ascontiguousarray(w[f"h{d}"].T * scale), w[f"n{d}"][:, None]
    h, out = np.zeros((n, batch), np.float32), np.empty((steps, n, batch), np.float32)
    a, b = np.empty((3 * n, batch), np.float32), np.empty((3 * n, batch), np.float32)
    gates, c = a[: 2 * n], b[2 * n :]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        np.take(wx, x[t], axis=1, out=a, mode="clip")
        np.matmul(wh, h, out=b)
        gates += b[: 2 * n]
        np.tanh(gates, out=gates)
        gates *= half
        gates += half
        c += bn
        c *= gates[n:]
        c += a[2 * n :]
        np.tanh(c, out=c)
        np.subtract(h, c, out=out[t])
        h = out[t]
        h *= gates[:n]
        h += c
    return out


def probabilities(w: Weights, x: np.ndarray) -> np.ndarray:
    """Class probabilities of every byte: (steps, classes, batch)."""
    n = w["hf"].shape[0]
    p = np.matmul(w["o"][:n].T, _states(w, "f", x))
    p += np.matmul(w["o"][n:].T, _states(w, "b", x))
    p += w["c"][:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def gradients(w: Weights, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over the bytes in ``mask`` and its gradients, back through all steps."""
    n = w["hf"].shape[0]
    kept: dict[str, list] = {"f": [], "b": []}
    states = {d: _layer(w, d, x, kept[d]) for d in "fb"}
    p = states["f"] @ w["o"][:n] + states["b"] @ w["o"][n:] + w["c"]
    p = np.exp(p - p.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    total = max(1.0, float(mask.sum()))
    picked = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[..., 0]
    loss = float(-(np.log(picked + 1e-9) * mask).sum() / total)
    d = p.copy()
    d[:, np.arange(len(y)), y] -= 1
    d *= (mask / total)[..., None].astype(np.float32)
    both = np.concatenate([states["f"], states["b"]], axis=2)
    g: Weights = {"o": np.einsum("tbh,tbc->hc", both, d), "c": d.sum((0, 1))}
    back = d @ w["o"].T
    for k, way in enumerate("fb"):
        wh = w[f"h{way}"]
        gx, gh, gn = np.zeros_like(w[f"x{way}"]), np.zeros_like(wh), np.zeros(n, np.float32)
        dh = np.zeros((x.shape[1], n), np.float32)
        for t, h, z, r, b3, c in reversed(kept[way]):
            dh = dh + back[t, :, k * n : (k + 1) * n]
            dz = dh * (h - c) * z * (1 - z)
            dc = dh * (1 - z) * (1 - c * c)
            dr = dc * b3 * r * (1 - r)
            db3 = dc * r
            db = np.concatenate([dz, dr, db3], axis=1)
            gh += h.T @ db
            gn += db3.sum(0)
            np.add.at(gx, x[t], np.concatenate([dz, dr, dc], axis=1))
            dh = dh * z + db @ wh.T
        g |= {f"x{way}": gx, f"h{way}": gh, f"n{way}": gn}
    return loss, g


def train(texts: list[list[bytes]], labels: np.ndarray, n_classes: int, rounds: int = 240, batch: int = 160, seed: int = 7) -> Weights:
    """Adam on random stretches of the texts, the classes drawn equally often; more than eight classes get more rounds."""
    rounds = rounds * max(8, n_classes) // 8
    w, r = initial(n_classes, seed=seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    of = [np.flatnonzero(labels == k) for k in range(n_classes)]
    for i in range(1, rounds + 1):
        y = r.integers(n_classes, size=batch)
        x, mask = np.zeros((STEPS, batch), np.uint8), np.zeros((STEPS, batch), np.float32)
        for j, k in enumerate(y):
            t = texts[r.choice(of[k])]
            s = np.frombuffer(t[int(r.integers(len(t)))], np.uint8)
            x[: len(s), j], mask[: len(s), j] = s, 1
        _, g = gradients(w, x, y, mask)
        rate = 0.02 * min(1.0, i / 20) * (1 - 0.9 * i / rounds)
        for k in w:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            w[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return w


def fit(docs: DataFrame, trained_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], Weights | None]:
    """All languages and weights, learned from rows where ``trained_on`` holds.

    At most ``sample`` documents of each language are used, those with the smallest hash
    of the id, and ``STRETCHES`` stretches of ``STEPS`` bytes from anywhere in each of them.
    Rows without text, language or id are left out. Rows that repeat an id count each towards ``sample``. Other columns
    are not read, whatever their names. Without rows there are no languages and no weights.
    """
    known = docs.where(trained_on & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) > 0))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("body"))
    first = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")  # Spark keeps the first rows of each task before it shuffles
    ids = known.select("id", "lang").withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("id", "lang").distinct()
    at = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.pmod(F.xxhash64("id", k), F.greatest(F.length("body") - STEPS + 1, F.lit(1))).cast("int"))
    picked = known.join(F.broadcast(ids), ["id", "lang"], "left_semi")
    picked = picked.select("lang", F.transform(at, lambda p: F.substring("body", p + 1, F.lit(STEPS))).alias("parts"))
    # rows that repeat an id go beyond the sample; each task keeps the first ones before they are shuffled
    again = W.partitionBy("lang").orderBy(F.xxhash64("parts"))
    rows = picked.withColumn("n", F.row_number().over(again)).where(F.col("n") <= sample).select("lang", "parts").collect()
    rows = sorted((r["lang"], [bytes(x) for x in r["parts"]]) for r in rows)
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return [], None
    number = {lang: k for k, lang in enumerate(langs)}
    return langs, train([parts for _, parts in rows], np.array([number[lang] for lang, _ in rows]), len(langs))


def _pooled(w: Weights, flat: np.ndarray, at: np.ndarray, n_classes: int) -> np.ndarray:
    """Mean class probabilities of every text; 0 for empty ones."""
    size = np.diff(at)
    parts = -(-size // STEPS)
    row = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = at[row] + nth * STEPS
    room = np.minimum(STEPS, at[row + 1] - start)
    total = np.zeros((len(size), n_classes))
    padded = np.concatenate([flat, np.zeros(STEPS, np.uint8)])
    step = np.arange(STEPS)
    for lo in range(0, len(row), 4096):
        s, n = start[lo : lo + 4096], room[lo : lo + 4096]
        mask = step[:, None] < n[None, :]
        x = np.where(mask, padded[s[None, :] + step[:, None]], np.uint8(0))
        p = probabilities(w, x)
        p *= mask[:, None, :]
        np.add.at(total, row[lo : lo + 4096], p.sum(0).T)
    return total / np.maximum(1, size)[:, None]


def identify(docs: DataFrame, langs: list[str], weights: Weights | None, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """One row per document: ``doc_id``, the columns in ``carry``, ``lang_pred, score``.

    The label is the language with the largest mean probability over the bytes of the
    whole text, and ``score`` that mean. The network reads stretches of ``STEPS`` bytes, each from a
    fresh state. Rows that repeat an id come out as often. A null text, an empty one and one without a letter is
    ``und`` with score 1; so is every text when nothing could be learned, with score 0.
    """
    src = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *(carry or []))
    rest = src.drop("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", lang_pred string, score double"
    scratch.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((langs, weights))
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, w = model.value
        for b in batches:
            flat, at = wd.buffers(b.column(0))
            seen = np.concatenate([[0], np.cumsum(letter[flat])])
            known = seen[at[1:]] > seen[at[:-1]]
            for i in np.flatnonzero(~known & (np.diff(at) > 0)):
                known[i] = any(map(str.isalpha, b.column(0)[i].as_py()))
            label, score = [UNDETERMINED] * b.num_rows, np.where(known, 0.0, 1.0)
            if w is not None:
                p = np.concatenate([_pooled(w, flat[at[i] : at[j]], at[i : j + 1] - at[i], len(langs)) for i, j in wd.slices(at)]) if b.num_rows else np.zeros((0, len(langs)))
                best = p.argmax(1)
                label = [langs[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)]
                score = np.where(known, np.minimum(1, p.max(1, initial=0)), 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(label, pa.string()), pa.array(score)], names=[*b.schema.names[1:], "lang_pred", "score"])

    return src.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the document is kept out of training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """Train on the documents that aren't held out and predict all: ``doc_id, held_out, lang_pred, score``."""
    langs, weights = fit(docs, ~held_out())
    return identify(docs, langs, weights, carry=[held_out().alias("held_out")])
