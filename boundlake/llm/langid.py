"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams of the text with ASCII case folded and every
other ASCII byte that is no letter read as a blank, so that word edges count.
The model is trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows; its probabilities are calibrated by a temperature on
rows kept apart, which also fix the probability below which it rejects.

Null text, or text without a letter: ``und`` with score 0, rejected. With no
labelled row everything is ``und``. Repeated rows are each predicted. Texts are
read whole, both in training and in prediction.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .stores import map_rows
from .textnp import steps, utf8

GRAMS = (2, 3, 4)
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DIM = 16
UNDETERMINED = "und"
#: Bytes of text predicted at a time; bounds the wide temporaries.
PREDICT_BYTES = 1 << 18

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


@dataclass
class Model:
    """At most ``BUCKETS * len(GRAMS) * DIM`` floats, whatever the corpus."""

    langs: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _buckets(folded: np.ndarray, k: int) -> np.ndarray:
    """Bucket of the n-gram of the k-th length that starts at each byte."""
    n = GRAMS[k]
    size = max(len(folded) - n + 1, 0)
    code = np.zeros(size, np.uint32)
    for j in range(n):
        code |= folded[j : j + size].astype(np.uint32) << np.uint32(8 * j)
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - BUCKET_BITS)
    return code.view(np.int32) + np.int32(k * BUCKETS)


def gram_buckets(raw: np.ndarray) -> list[np.ndarray]:
    folded = _FOLD[raw]
    return [_buckets(folded, k) for k in range(len(GRAMS))]


def averages(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean over each row's n-grams of the table's rows."""
    total = np.zeros((len(offsets) - 1, table.shape[1]))
    count = np.zeros(len(offsets) - 1)
    folded = _FOLD[raw]
    for k, n in enumerate(GRAMS):
        buckets = _buckets(folded, k)
        begin = np.minimum(offsets[:-1], len(buckets))
        end = np.clip(offsets[1:] - n + 1, begin, len(buckets))
        count += end - begin
        for c in range(table.shape[1]):
            run = np.zeros(len(buckets) + 1)
            np.cumsum(table[buckets, c], out=run[1:])
            total[:, c] += run[end] - run[begin]
    return total / np.maximum(count, 1)[:, None]


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for row in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[row] = any(map(str.isalpha, raw[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "ignore")))
    return out


def _features(docs: DataFrame) -> DataFrame:
    """(lang, key, buckets, shares) of rows (lang, text, key): each n-gram distribution, whatever the text's length."""

    def run(batches):
        for batch in batches:
            buckets, shares = [], []
            for value in batch.column(1).to_pylist():
                raw = np.frombuffer(value.encode(), np.uint8)
                found, counts = np.unique(np.concatenate(gram_buckets(raw)), return_counts=True)
                buckets.append(found.astype(np.int32))
                shares.append((counts / max(counts.sum(), 1)).astype(np.float32))
            columns = [batch.column(0), batch.column(2), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "key", "buckets", "shares"])

    return docs.mapInArrow(run, "lang string, key long, buckets array<int>, shares array<float>")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(langs: list[str], buckets: list[np.ndarray], shares: list[np.ndarray], epochs: int = 8, rate: float = 4.0, seed: int = 7) -> Model:
    """Stochastic gradient descent on four fifths of the rows, calibration on the rest."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], dtype=np.int64)
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (BUCKETS * len(GRAMS), DIM)).astype(np.float32) / DIM
    w, b = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    order = rng.permutation(len(y))
    apart, train = order[: len(y) // 5], order[len(y) // 5 :]
    step, total = 0, max(epochs * len(train), 1)
    for _ in range(epochs):
        for i in rng.permutation(train):
            lr = rate * (1 - step / total)
            step += 1
            at, share = buckets[i], shares[i]
            hidden = share @ e[at]
            error = _softmax(hidden @ w + b)
            error[y[i]] -= 1
            back = w @ error
            w -= lr * 0.1 * np.outer(hidden, error)
            b -= lr * 0.01 * error
            e[at] -= (lr * share / (share.max() + 1e-9))[:, None] * (0.05 * back)
    model = Model(names, e, w, b, 1.0, 0.0)
    if len(apart):
        logits = np.array([shares[i] @ e[buckets[i]] @ w + b for i in apart], dtype=np.float64)
        best = min(np.geomspace(1, 20, 40), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(apart)), y[apart]] + 1e-12).mean())
        model.temperature = float(best)
        p = _softmax(logits / best)
        right = p.max(axis=1)[p.argmax(axis=1) == y[apart]]
        # Of rows it gets right, about one in a thousand may be rejected; half is always enough.
        model.threshold = float(min(np.quantile(right, 0.001), 0.5)) if len(right) else 0.5
    return model


def train(docs: DataFrame, allowed: Column, per_lang: int = 600, most_rows: int = 60_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model from at most ``per_lang`` rows of every language, or fewer of each where that would pass ``most_rows``.

    Rows are drawn by a hash of id and text among the ``allowed`` ones, and equal
    rows count as one; every language that has a row with a letter is learned.
    The drawn rows' n-gram distributions, of bounded size each, are all that
    reaches the driver, in one order whatever order they arrive in.
    """
    spark = ship(docs.sparkSession)
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    draw = F.pmod("key", F.lit(1 << 30))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"), F.min(draw).alias("least")).collect()
    if not counts:
        return Model([], np.zeros((BUCKETS * len(GRAMS), DIM), np.float32), np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    each = max(min(per_lang, most_rows // len(counts)), 1)
    # The row with the least draw always counts, so that no language is left out.
    # An Arrow table needs no Python workers; a list of rows would start some on every executor beside those of the functions.
    limits = [max(int((1 << 30) * min(1.0, 1.5 * each / r.n)), r.least + 1) for r in counts]
    below = spark.createDataFrame(pa.table({"lang": pa.array([r.lang for r in counts], pa.string()), "below": pa.array(limits, pa.int64())}))
    drawn = rows.join(F.broadcast(below), "lang").where(draw < F.col("below")).groupBy("lang", "key").agg(F.min("text").alias("text"))
    # A few more than wanted are drawn, as their number is an estimate; the first by hash stay.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "key"))
    sample = _features(drawn.withColumn("place", place).where(F.col("place") <= each).select("lang", "text", "key")).toArrow()
    langs, keys = (sample.column(c).to_pylist() for c in ("lang", "key"))
    lists = [sample.column(c).combine_chunks() for c in ("buckets", "shares")]
    cut = np.asarray(lists[0].offsets, dtype=np.int64)
    buckets, shares = (np.asarray(x.values) for x in lists)
    parts = [(slice(cut[i], cut[i + 1]), langs[i]) for i in np.lexsort([keys, langs])]
    return fit([lang for _, lang in parts], [buckets[s] for s, _ in parts], [shares[s] for s, _ in parts])


def _predictor(spark, model: Model):
    """Function of a text column that gives languages, scores and rejections."""
    # With few languages the workers get the table of their scores, which is smaller than the embedding.
    small = len(model.langs) <= DIM
    table = model.embedding @ model.weights if small else model.embedding
    shared = spark.sparkContext.broadcast((replace(model, embedding=table[:0]), table))

    def predict(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, table = shared.value
        names = np.array([*m.langs, UNDETERMINED], dtype=object)
        raw, offsets = utf8(column)
        pred, score = np.full(len(column), len(m.langs)), np.zeros(len(column))
        for a, b in steps(offsets, PREDICT_BYTES):
            part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            mean = averages(part, at, table)
            if not m.langs:
                continue
            p = _softmax(((mean if small else mean @ m.weights) + m.bias) / m.temperature)
            clear = has_letter(part, at)
            pred[a:b] = np.where(clear, p.argmax(axis=1), len(m.langs))
            score[a:b] = np.where(clear, p.max(axis=1), 0.0)
        return names[pred], score, (pred == len(m.langs)) | (score < m.threshold)

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row."""
    predict = _predictor(ship(docs.sparkSession), model)

    def run(batches):
        for batch in batches:
            lang, score, rejected = predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language the model accepts."""
    predict = _predictor(ship(docs.sparkSession), model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~predict(batch.column(at))[2]))

    return map_rows(docs, run)
