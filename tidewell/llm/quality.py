"""Operator 3, quality classifier: a generalised additive model with pairwise interactions.

Features are ratios of whole-text counts. Each feature is cut into quantile bins; shallow trees
over one feature at a time, boosted in turn around all features, add up to one table of values a
feature; the same is then done on the residuals for the pairs of features that gain most. A text's
score is the logistic of the sum of its table values, looked up for a whole batch by its bins.

Defined results: null text is the empty text and gets a score like any other. Without labels of
both values in the training part every score is the share of label 1 (0.5 with no labels). Where a
document has several labels each counts. The training sample is at most ``SAMPLE`` rows. Equal features give equal scores;
equally good cuts are taken in one fixed order. Very long texts are counted whole; an empty table gives no rows; rows that repeat are
scored each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.rules import counts
from tidewell.session import written

FEATURES = ("log_words", "word_length", "upper", "digit", "punct", "space", "other", "symbols", "dup_lines", "repeat_words", "distinct", "again", "short", "log_chars")
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
THRESHOLD = 0.7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, an array by FEATURES, for every row of docs."""
    c = counts(docs.select("doc_id", "text"), more=True)
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("n_chars", F.lit(1))
    kind = lambda i: F.get("classes", F.lit(i)) / chars
    x = [F.log1p("n_words"), F.col("word_chars") / words, kind(1), kind(2), kind(3), kind(4), kind(5), F.col("n_symbols") / chars, F.log1p("n_dup_lines"), F.col("n_repeat_words") / words, F.col("n_distinct") / words, F.col("n_again") / words, F.col("n_short") / words, F.log1p("n_chars")]
    return c.select("doc_id", F.array(*[v.cast("double") for v in x]).alias("x"))


class Additive:
    """Intercept, a table for each feature, and tables for pairs of features."""

    def __init__(self, intercept: float = 0.0):
        self.intercept, self.edges, self.tables = intercept, [], []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.pair_edges: list[np.ndarray] = []

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sums of the table values of each row: one vector lookup and addition for each table."""
        out = np.full(len(x), self.intercept)
        fine, coarse = self.bins(x, self.edges), self.bins(x, self.pair_edges)
        for j, table in enumerate(self.tables):
            out += table[fine[:, j]]
        for a, b, table in self.pairs:
            out += table[coarse[:, a], coarse[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, low: int, high: int, least: float = 1.0) -> tuple[float, int]:
    """(gain, place) of the best cut of bins low..high by the sums of gradients and curvatures."""
    gs, hs = np.cumsum(g[low:high]), np.cumsum(h[low:high])
    if len(gs) < 2:
        return 0.0, low
    left_g, left_h, right_g, right_h = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
    gain = left_g**2 / (left_h + least) + right_g**2 / (right_h + least) - gs[-1] ** 2 / (hs[-1] + least)
    k = int(gain.argmax())
    return float(gain[k]), low + k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, least: float = 1.0) -> np.ndarray:
    """A tree over one feature's bins with few leaves, as a value for each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, part = max((*_best_cut(g, h, *p, least), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    out = np.zeros(len(g))
    for low, high in parts:
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + least)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree over a grid of bins that cuts one feature, then the other on each side."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, gg.shape[0]):
            gain, out = 0.0, np.zeros_like(gg)
            for side in (slice(0, cut), slice(cut, None)):
                sg, sh = gg[side].sum(axis=0), hh[side].sum(axis=0)
                more, at = _best_cut(sg, sh, 0, len(sg), least)
                gain += more + sg.sum() ** 2 / (sh.sum() + least)
                for part in (slice(0, at), slice(at, None)) if at else (slice(None),):
                    out[side, part] = sg[part].sum() / (sh[part].sum() + least)
            if gain > best[0]:
                best = (gain, out.T if turned else out)
    return best


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15) -> Additive:
    """Cyclic boosting of the features' tables, then of the strongest pairs'."""
    if len(y) == 0:
        return Additive(0.0)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Additive(float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    fine, coarse = model.bins(x, model.edges), model.bins(x, model.pair_edges)
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(fine[:, j], g, len(table)), np.bincount(fine[:, j], h, len(table)))
            table += step
            margin += step[fine[:, j]]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        n, m = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        return np.bincount(coarse[:, a] * m + coarse[:, b], v, n * m).reshape(n, m)

    g, h = slopes()
    ranked = sorted(((pair_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1))) for _, a, b in ranked[:PAIRS]]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            g, h = slopes()
            step = rate * pair_tree(grid(a, b, g), grid(a, b, h))[1]
            table += step
            margin += step[coarse[:, a], coarse[:, b]]
    return model


def training_sample(feats: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most SAMPLE rows outside the held-out part, drawn by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality in (0, 1)").where(~held_out(F.col("doc_id")))
    rows = feats.join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id", "quality").limit(SAMPLE).select("x", "quality").collect()
    return np.array([r[0] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    feats = written(features(docs), "quality-features")
    model = fit(*training_sample(feats, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            score = model.score(flat.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return feats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x").mapInArrow(run, SCHEMA)
