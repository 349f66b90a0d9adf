"""Quality classifier by positive-unlabelled learning with non-negative risk.

Trusted positives and unlabelled text give the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; the class prior is estimated
from the two samples. The model is additive over binned text statistics.

Null text counts as empty and is scored like any other. Without positives or
without unlabelled rows every score is the starting prior. Repeated rows are
each scored. Inputs of a score are the text's statistics alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .textnp import NON_SPACE, byte_class, steps, utf8, word_hashes, word_spans

NAMES = ("words", "word_length", "distinct", "adjacent", "upper", "digits", "symbols", "shouts", "bars", "stops", "commas", "lines", "dup_lines", "other_punct", "high_bytes", "repeat_pairs")
BINS = 12
#: Edges of bins besides the quantiles.
STEPS = np.array([0.001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 0.95, 1.5, 2.5, 4.0, 7.0, 10.0])

_CLASSES = {
    "upper": byte_class((0x41, 0x5A)),
    "digits": byte_class((0x30, 0x39)),
    "symbols": sum((byte_class((ord(c), ord(c))) for c in "#*$%&<>"), np.zeros(256, bool)),
    "shouts": sum((byte_class((ord(c), ord(c))) for c in "!?"), np.zeros(256, bool)),
    "bars": byte_class((0x7C, 0x7C)),
    "stops": byte_class((0x2E, 0x2E)),
    "commas": byte_class((0x2C, 0x2C)),
    "other_punct": sum((byte_class((ord(c), ord(c))) for c in "@[]{}()=+_/\\~^:;\"'-"), np.zeros(256, bool)),
    "high_bytes": byte_class((0x80, 0xFF)),
}
_NOT_NEWLINE = ~byte_class((0x0A, 0x0A))


def _distinct(row: np.ndarray, keys: np.ndarray, rows: int) -> np.ndarray:
    """Different keys in each row; 40 bits of a key are told apart, enough for a statistic."""
    mixed = np.sort((row.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))
    first = np.ones(len(mixed), bool)
    first[1:] = mixed[1:] != mixed[:-1]
    return np.bincount((mixed[first] >> np.uint64(40)).astype(np.int64), minlength=rows)


def features(column: pa.Array) -> np.ndarray:
    """Statistics of each whole text, one row of ``NAMES`` each."""
    raw, offsets = utf8(column)
    out = np.zeros((len(column), len(NAMES)))
    for a, b in steps(offsets):
        part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, n = word_spans(part, at, NON_SPACE)
        h = word_hashes(part, starts, ends)
        row = np.repeat(np.arange(b - a), n)
        some = np.maximum(n, 1)
        f = {"words": np.log1p(n), "word_length": np.bincount(row, ends - starts, minlength=b - a) / some, "distinct": _distinct(row, h, b - a) / some}
        same_row = row[1:] == row[:-1]
        f["adjacent"] = np.bincount(row[1:][same_row & (h[1:] == h[:-1])], minlength=b - a) / some
        pairs = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
        pairs ^= pairs >> np.uint64(29)
        pairs *= np.uint64(0xBF58476D1CE4E5B9)
        f["repeat_pairs"] = 1 - _distinct(row[1:][same_row], pairs[same_row], b - a) / np.maximum(n - 1, 1)
        for name, table in _CLASSES.items():
            run = np.concatenate([[0], np.cumsum(table[part])])
            f[name] = (run[at[1:]] - run[at[:-1]]) / some
        ls, le, m = word_spans(part, at, _NOT_NEWLINE)
        f["lines"] = m / some
        line_row = np.repeat(np.arange(b - a), m)
        f["dup_lines"] = 1 - _distinct(line_row, word_hashes(part, ls, le), b - a) / np.maximum(m, 1)
        out[a:b] = np.column_stack([f[k] for k in NAMES])
    return out


@dataclass
class Model:
    """A few hundred numbers."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Column of the one-hot bin of each statistic."""
    out = np.empty(x.shape, np.int64)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(edges[j], x[:, j], side="right") + j * (edges.shape[1] + 1)
    return out


def _logits(bins: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return weights[bins].sum(axis=1) + bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _descend(p: np.ndarray, u: np.ndarray, size: int, gradient, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam on the additive weights; ``gradient`` gives each row's weight in the loss."""
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        gp, gu = gradient(_logits(p, w, b), _logits(u, w, b))
        g = np.bincount(p.ravel(), np.repeat(gp, p.shape[1]), size) + np.bincount(u.ravel(), np.repeat(gu, u.shape[1]), size) + decay * w
        g = np.append(g, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, b


def estimate_prior(p: np.ndarray, u: np.ndarray, size: int, rounds: int = 150) -> float:
    """Share of positives among the unlabelled rows.

    A classifier of positives against unlabelled rows is fitted on one half; on
    the other half, P(u above t) / P(p above t) is at least the share for each
    threshold t and near it where negatives have thinned out. Among thresholds
    that keep most positives the median ratio is taken, as the least one would
    follow the noise.
    """
    if len(p) < 20 or len(u) < 20:
        return 0.5
    half = lambda x, k: x[k::2]
    w, b = _descend(half(p, 0), half(u, 0), size, lambda fp, fu: (-_sigmoid(-fp) / len(fp), _sigmoid(fu) / len(fu)), rounds, 0.05, 1e-3)
    sp, su = _logits(half(p, 1), w, b), _logits(half(u, 1), w, b)
    cuts = np.quantile(sp, np.linspace(0.02, 0.5, 97))
    above_p = (sp[None, :] >= cuts[:, None]).mean(axis=1)
    above_u = (su[None, :] >= cuts[:, None]).mean(axis=1)
    ratio = above_u / np.maximum(above_p, 1e-9)
    return float(np.clip(np.median(ratio), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 500, rate: float = 0.2) -> Model:
    """Minimise the non-negative risk with the logistic loss."""
    both = np.concatenate([positive, unlabelled])
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    spread = np.quantile(both, quantiles, axis=0).T if len(both) else np.zeros((len(NAMES), len(quantiles)))
    # Rare values matter most, so fixed steps tell them apart where quantiles don't.
    edges = np.sort(np.concatenate([spread, np.tile(STEPS, (len(NAMES), 1))], axis=1), axis=1)
    size = len(NAMES) * (edges.shape[1] + 1)
    if not len(positive) or not len(unlabelled):
        return Model(edges, np.zeros(size), 0.0, 0.5)
    p, u = _binned(positive, edges), _binned(unlabelled, edges)
    prior = estimate_prior(p, u, size)

    def gradient(fp, fu):
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp, gu = -prior * _sigmoid(-fp) / len(fp), np.zeros(len(fu))
        if negative >= 0:
            return gp - prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
        # Below zero the negative part is pushed back up, and nothing else moves.
        return prior * _sigmoid(fp) / len(fp), gu - _sigmoid(fu) / len(fu)

    w, b = _descend(p, u, size, gradient, rounds, rate, 0.4 / len(positive))
    # The mean score of unlabelled rows should be the prior; scores near 0 and 1 hardly move.
    f, low, high = _logits(u, w, b), -20.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(f + middle).mean() < prior else (low, middle)
    return Model(edges, w, b + min(low, 0.0), prior)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Model from at most ``most`` positives and ``most`` unlabelled rows.

    Ids are drawn by a hash among ``allowed`` ones, positives where ``label_col``
    is 1, unlabelled ones from documents without a label (from all documents if
    each has one). An id that repeats counts once, by its least text. Only ids and
    statistics of the drawn rows reach the driver.
    """
    spark = ship(docs.sparkSession)
    draw = F.xxhash64(F.col(id_col))

    def drawn(ids: DataFrame) -> DataFrame:
        # A few more than wanted pass the threshold, as the number of ids is an estimate; the first by hash stay.
        n = max(ids.agg(F.approx_count_distinct(id_col)).first()[0], 1)
        part = ids.where(F.pmod(draw, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * most / n)))
        return spark.createDataFrame(part.distinct().orderBy(draw, id_col).limit(most).toArrow())

    def statistics(ids: DataFrame) -> np.ndarray:
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(list(features(batch.column(0))), pa.list_(pa.float64()))], names=["f"])

        # ``ids`` holds at most ``most`` of them, so it may be broadcast.
        rows = docs.join(F.broadcast(ids), id_col, "left_semi").groupBy(id_col).agg(F.min(text_col).alias("text"))
        found = rows.select("text").mapInArrow(run, "f array<double>").toArrow()
        x = np.array(found.column(0).to_pylist(), dtype=float).reshape(-1, len(NAMES))
        return x[np.lexsort(x.T)]

    positive = labels.where(allowed & (F.col(label_col) == 1)).select(id_col).where(F.col(id_col).isNotNull())
    without = docs.where(allowed & F.col(id_col).isNotNull()).select(id_col).join(labels.select(id_col), id_col, "left_anti")
    if without.isEmpty():
        without = docs.where(allowed & F.col(id_col).isNotNull()).select(id_col)
    return fit(statistics(drawn(positive)), statistics(drawn(without)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the model's probability of a good document."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            m = shared.value
            p = _sigmoid(_logits(_binned(features(batch.column(1)), m.edges), m.weights, m.bias))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")
