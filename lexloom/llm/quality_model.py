"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles over its features.

Every feature is cut into at most BINS bins at quantiles of the training sample. In each round each feature in turn gets
a shallow tree (two cuts) fitted to the current residuals with a small step, which adds to that feature's lookup table.
Then the PAIRS pairs of features whose two-by-two splits explain most of what is left get tables of their own, boosted
the same way with a cut of one feature and a cut of the other on each side. A score is the logistic of an intercept and
one entry of each table, so scoring is binning and vectorised additions.

The model is fitted on the driver from at most TRAIN_ROWS labelled documents (the smallest hashes of the id among the
rows that may be learned from); only their feature rows are gathered, about 2 MB. Everything is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import whole

TRAIN_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.15
L2 = 1.0

FEATURES = ("size", "upper", "digits", "symbols", "pipes", "shouts", "stops", "commas", "beyond_ascii", "lines", "word_length", "long_words", "distinct", "doubled", "top_share")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _SYMBOL = _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"0123456789"), _class(b"#$%&*<>=@^_~\\/{}[]+")


def features(text: str | None) -> list[float]:
    """The numbers a score rests on; of the text alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count, words = np.bincount(np.frombuffer(raw, np.uint8), minlength=256), raw.split()
    n, w = max(len(raw), 1), max(len(words), 1)
    distinct = set(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        float(np.log2(1 + len(words))), count[_UPPER].sum() / n, count[_DIGIT].sum() / n, count[_SYMBOL].sum() / w, count[124] / w, count[33] / w,
        (count[46] + count[63]) / w, count[44] / w, count[128:].sum() / n, count[10] / w, float(lengths.sum() / w), float((lengths > 9).sum() / w), len(distinct) / w,
        sum(map(eq, words, words[1:])) / w, float(np.log2(w / max(len(distinct), 1))),
    ]


class AdditiveModel:
    """Lookup tables for features and pairs of them."""

    def __init__(self) -> None:
        self.intercept, self.cuts, self.tables, self.pairs = 0.0, [], [], []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1) if len(self.cuts) else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = self._bin(x), np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            z += table[b[:, f]]
        for f, g, cf, cg, table in self.pairs:
            z += table[np.searchsorted(cf, x[:, f], side="left"), np.searchsorted(cg, x[:, g], side="left")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(y):
            return self
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.intercept = float(np.log(p / (1 - p)))
        if y.min() == y.max():
            return self
        at = lambda n: np.linspace(0, 1, n + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], at(BINS), method="lower")) for f in range(x.shape[1])]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        b, z = self._bin(x), np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                q = 1 / (1 + np.exp(-z))
                step = _line_tree(np.bincount(b[:, f], y - q, len(table)), np.bincount(b[:, f], q * (1 - q), len(table)))
                table += RATE * step
                z += RATE * step[b[:, f]]
        cuts = [np.unique(np.quantile(x[:, f], at(PAIR_BINS), method="lower")) for f in range(x.shape[1])]
        c = np.stack([np.searchsorted(k, x[:, f], side="left") for f, k in enumerate(cuts)], axis=1)
        q = 1 / (1 + np.exp(-z))
        grid = lambda f, g, v: np.bincount(c[:, f] * (len(cuts[g]) + 1) + c[:, g], v, (len(cuts[f]) + 1) * (len(cuts[g]) + 1)).reshape(len(cuts[f]) + 1, -1)
        gains = sorted(((_quadrants(grid(f, g, y - q), grid(f, g, q * (1 - q))), f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)
        self.pairs = [(f, g, cuts[f], cuts[g], np.zeros((len(cuts[f]) + 1, len(cuts[g]) + 1))) for gain, f, g in gains[:PAIRS] if gain > 0]
        for _ in range(PAIR_ROUNDS):
            for f, g, _, _, table in self.pairs:
                q = 1 / (1 + np.exp(-z))
                step = _plane_tree(grid(f, g, y - q), grid(f, g, q * (1 - q)))
                table += RATE * step
                z += RATE * step[c[:, f], c[:, g]]
        return self


def _gain(g: np.ndarray | float, h: np.ndarray | float) -> np.ndarray | float:
    return g * g / (h + L2)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; place 0 if none helps."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gains))
    return (float(gains[k]), k + 1) if gains[k] > 1e-9 else (0.0, 0)


def _line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a tree with at most two cuts of one feature, by bin."""
    edges = [0, len(g)]
    for _ in range(2):
        gain, cut = max((gain, a + k) for a, b in zip(edges, edges[1:], strict=False) for gain, k in [_best_cut(g[a:b], h[a:b])])
        if gain <= 0:
            break
        edges = sorted({*edges, cut})
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + L2)
    return out


def _plane_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a depth-two tree over two features: the cut of the first after which cuts of the second, one on each side, gain most."""
    best: tuple[float, list[slice]] = (-1.0, [slice(0, len(g))])
    for cut in range(len(g)):
        sides = [slice(0, cut), slice(cut, len(g))] if cut else [slice(0, len(g))]
        sums = [(g[rows].sum(axis=0), h[rows].sum(axis=0)) for rows in sides]
        best = max(best, (sum(_best_cut(*x)[0] + float(_gain(x[0].sum(), x[1].sum())) for x in sums), sides), key=lambda x: x[0])
    out = np.zeros(g.shape)
    for rows in best[1]:
        _, k = _best_cut(g[rows].sum(axis=0), h[rows].sum(axis=0))
        for cols in [slice(0, k), slice(k, g.shape[1])] if k else [slice(0, g.shape[1])]:
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + L2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> float:
    """Best gain of a cut of each feature at once."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0
    parts = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    return float((sum(_gain(a, b) for a, b in zip(parts(gc), parts(hc), strict=True)) - _gain(gc[-1, -1], hc[-1, -1])).max())


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fits the model. Of several labels of an id the largest counts; null ids and labels are left out; without labels every score is 0.5."""
    own = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    own = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"].astype(str), "y": batch["y"], "x": [features(t) for t in batch["text"]]})

    docs = documents.select(documents[id_col].alias("id"), whole(documents[text_col]).alias("text")).join(F.broadcast(own), "id")
    # an id that several texts have gives one row, the least of their features: no more rows come to the driver than ids
    measured = docs.mapInPandas(measure, "id string, y int, x array<double>").groupBy("id", "y").agg(F.min("x").alias("x"))
    got = sorted((r["id"], r["y"], list(r["x"])) for r in measured.collect())
    x = np.array([r[2] for r in got]).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, np.array([float(r[1] > 0) for r in got]))


def score(documents: DataFrame, model: AdditiveModel, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: its id, held_out, score (0 to 1), predicted (1 from the threshold up).

    Null texts are scored as empty ones. Repeated rows give equal scores, an empty table none. Other columns are not read.
    """

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([features(t) for t in batch["text"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"id": batch["id"], "held_out": batch["held_out"], "score": model.score(x)})

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(documents[id_col].alias("id"), held_out(documents[id_col]).alias("held_out"), whole(documents[text_col]).alias("text"))
    out = rows.mapInPandas(rate, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
