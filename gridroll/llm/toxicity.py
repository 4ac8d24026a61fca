"""Toxicity by a character n-gram linear classifier with naive Bayes features.

A text is the set of its byte n-grams (lower case in A-Z, white space as one
kind of blank, a blank at both ends), hashed into a fixed number of features.
The log-count ratio of a feature, from all labelled training texts, scales it;
a logistic regression on the scaled features is fitted to a bounded number of
labelled texts. Scoring looks up one number a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridroll.llm.common import join_small, smallest
from gridroll.llm.textvec import U64, flat, slices, trimmed
from gridroll.session import materialize, ship

#: Lengths of the n-grams, bits of a feature's number, standard errors that a ratio has to differ from none, labelled texts of each class that the regression is fitted to at most, and labels that may be broadcast.
ORDERS, BITS, SURE, FIT_EACH, LABELS_BROADCAST = (4, 6), 20, 3.5, 2500, 1_000_000


def _fold() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[9, 10, 11, 12, 13]] = 32
    return t


_FOLD = _fold()


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The sorted distinct features of each text; only those that are true in ``wanted``, if given."""
    kind = pa.large_string()
    blank = pa.scalar(" ", kind)
    padded = pc.binary_join_element_wise(blank, pc.fill_null(texts.cast(kind), ""), blank, pa.scalar("", kind))
    data, off = flat(padded)
    data = _FOLD[data].astype(U64)
    by_order = []
    for n in ORDERS:
        v = np.zeros(max(0, len(data) - n + 1), U64)
        for j in range(n):
            v |= data[j : j + len(v)] << U64(8 * j)
        v = (v * U64(0x9E3779B97F4A7C15 + 2 * n) >> U64(64 - BITS)).astype(np.int32)
        ok = np.ones(len(v), bool) if wanted is None else wanted[v]
        for end in range(1, n):  # no n-gram spans two texts
            over = off[1:-1] - end
            ok[over[(over >= 0) & (over < len(ok))]] = False
        at = np.flatnonzero(ok)
        by_order.append((v[at], np.searchsorted(at, off)))
    for i in range(len(off) - 1):
        yield np.unique(np.concatenate([v[o[i] : o[i + 1]] for v, o in by_order]))


def ratios(pos: np.ndarray, neg: np.ndarray, texts_pos: int, texts_neg: int, alpha: float = 1.0) -> np.ndarray:
    """Log-count ratios of features from the shares of texts of either class that have them; 0 where the ratio is within ``SURE`` standard errors of none."""
    p, q = pos + alpha, neg + alpha
    r = np.log(p / (texts_pos + 2 * alpha)) - np.log(q / (texts_neg + 2 * alpha))
    r[np.abs(r) < SURE * np.sqrt(1 / p + 1 / q)] = 0
    return r


def logistic(idx: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray, scale: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a ridge logistic regression on scaled binary features, by L-BFGS."""
    n_f = len(scale)
    used = np.unique(idx)
    small = np.zeros(n_f, np.int32)
    small[used] = np.arange(len(used))
    col, s = small[idx], scale[used]
    lens = np.diff(off)
    row = np.repeat(np.arange(len(y), dtype=np.int32), lens)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, weights=(w[:-1] * s)[col], minlength=len(y)) + w[-1]
        f = float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ridge * (w[:-1] ** 2).sum())
        e = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        return f, np.append(np.bincount(col, weights=e[row], minlength=len(used)) * s + ridge * w[:-1], e.sum())

    w = np.zeros(len(used) + 1)
    f, g = loss(w)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for dw, dg in reversed(memory):
            a = dw @ d / (dw @ dg)
            alphas.append(a)
            d = d - a * dg
        if memory:
            dw, dg = memory[-1]
            d = d * ((dw @ dg) / (dg @ dg))
        for (dw, dg), a in zip(memory, reversed(alphas), strict=True):
            d = d + (a - dg @ d / (dw @ dg)) * dw
        step = 1.0 if memory else 1.0 / max(1.0, float(np.abs(g).sum()))
        slope = float(g @ d)
        if slope > -1e-9 * max(1.0, abs(f)):
            break
        while True:
            f2, g2 = loss(w + step * d)
            if f2 <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        dw, dg = step * d, g2 - g
        w, f, g = w + dw, f2, g2
        if dw @ dg > 1e-12:
            memory = [*memory[-7:], (dw, dg)]
    out = np.zeros(n_f)
    out[used] = w[:-1] * s
    return out, float(w[-1])


@dataclass
class Model:
    """A score is the logistic function of ``bias`` plus the sum of ``coef`` over a text's features."""

    coef: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        wanted = self.coef != 0
        z = np.array([self.coef[f].sum() for f in features(texts, wanted)]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(labelled: DataFrame, fit_each: int = FIT_EACH) -> Model:
    """Fit to (doc_id, text, y), y 0 or 1. All rows count for the ratios; ``fit_each`` of each class, those of the smallest hashes, for the regression."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        texts = np.zeros(2, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                y = b.column("y").to_numpy()
                for f, k in zip(features(b.column("text")), y, strict=True):
                    seen[k, f] += 1
                texts += np.bincount(y, minlength=2)
        f = np.flatnonzero(seen.any(axis=0))
        if texts.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1)), pa.array(np.append(seen[0, f], texts[0])), pa.array(np.append(seen[1, f], texts[1]))], names=["f", "neg", "pos"])

    got = labelled.select("text", F.col("y").cast("int").alias("y")).mapInArrow(lambda it: trimmed(count(it)), "f long, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toArrow()  # 2 ** BITS + 1 rows at most
    f, neg, pos = (got.column(c).to_numpy() for c in ("f", "neg", "pos"))
    total = {"neg": int(neg[f < 0].sum()), "pos": int(pos[f < 0].sum())}
    if not total["neg"] or not total["pos"]:  # one class or none: the base rate
        rate = (total["pos"] + 0.0) / max(1, sum(total.values()))
        return Model(np.zeros(1 << BITS), float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))))
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    p[f[f >= 0]], q[f[f >= 0]] = pos[f >= 0], neg[f >= 0]
    r = ratios(p, q, total["pos"], total["neg"])
    wanted = r != 0
    idx, lens, ys = [], [], []
    for y, all_ in ((0, total["neg"]), (1, total["pos"])):
        for among in (all_, fit_each):  # where equal texts left too few below the hash threshold, once more without it
            some = smallest(labelled.where(F.col("y") == y).select("doc_id", "text"), ["doc_id", "text"], fit_each, among).select("text")
            sets = some.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes() for x in features(b.column("text"), wanted)], pa.binary())], names=["f"]) for whole in it for b in slices(whole, "text")), "f binary").toArrow().column("f")
            if 2 * len(sets) >= min(fit_each, all_):
                break
        for x in sets:
            a = np.frombuffer(x.as_buffer(), np.int32)
            idx.append(a)
            lens.append(len(a))
            ys.append(y)
    y = np.array(ys)
    weight = np.where(y == 1, total["pos"] / max(1, (y == 1).sum()), total["neg"] / max(1, (y == 0).sum()))
    weight = weight * len(y) / weight.sum()  # the classes keep their shares of all labelled texts
    coef, bias = logistic(np.concatenate(idx), np.concatenate([[0], np.cumsum(lens)]), y.astype(float), weight, r)
    return Model(coef, bias)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_each: int = FIT_EACH, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Toxicity of every row of ``docs``, learnt from ``labels`` (id, ``label_col`` 0 or 1).

    Rows whose crc32(id as text) mod 4 is 2 are held out: their labels are
    never read. Returns doc_id, held_out, score (0 to 1) and predicted (score
    >= ``threshold``). Only the text makes a score; a null text scores as an
    empty one. Labels that are null are ignored; of several labels of an id the
    largest counts. Without labels of both classes all texts get the base rate.
    A null id is not held out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    marks = materialize(labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y")).where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    labelled = join_small(slim.where(~F.col("held_out") & F.col("text").isNotNull()).select("doc_id", "text"), marks, ["doc_id"], limit=LABELS_BROADCAST)
    model = spark.sparkContext.broadcast(train(labelled, fit_each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                s = model.value.score(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return slim.mapInArrow(lambda it: trimmed(run(it)), f"doc_id {dict(slim.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
