"""Language-model scores by deleted interpolation of word n-grams.

Maximum-likelihood bigram and unigram estimates and a uniform floor are mixed
with weights that depend on how often the context was seen; the weights are
learned by expectation-maximisation on held-out counts: one fold of the
training texts is left out of the counts that predict it. The final
probabilities use the counts of all training texts.

How it is distributed: documents form blocks of a few MB. A block asks the
owners of its *different* words and bigrams, found by hash range, for their
counts, in one compressed message for each owner. Owners add up what all blocks
sent and answer in the same order. A frequent word is one entry of each block's
message, so no key is hot; no vocabulary is broadcast or collected.

Null texts are empty: one end token. Empty table: no rows. Repeated rows count
and are scored each. Without training rows scores fall back on the floor.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .stores import checkpointed
from .textnp import LOWER, NON_SPACE, gathered, mix, pack, steps, unpack, utf8, word_hashes, word_spans

BLOCK_BYTES = 6 << 20
#: Roles of a document: scored only, counted, counted and predicted in EM.
SCORED, MAIN, APART = 0, 1, 2
END = np.uint64(0x51ED270B0E4D6A1F)
_U = np.uint64
#: Bits that a bigram's hash leaves out.
PAIR_SHIFT = 8
WORD_SHIFT = 16
#: Steps of the histogram's log2 scales, and the code of a zero.
FINE, ZERO = 8, 10_000


def _pair_hash(words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """56-bit hashes of bigrams, given as first * words + second; words by 48 bits.

    Eight bits less than words have make messages a sixth smaller; at 10**8
    different bigrams fewer than one in 10**8 shares another's count.
    """
    n = max(len(words), 1)
    return mix(words[pairs // n] * _U(0x9E3779B97F4A7C15) + words[pairs % n]) >> _U(PAIR_SHIFT)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different words by hash, word number of each token, tokens of each row).

    Every row ends with the end token, which also stands before its first word.
    """
    raw, offsets = utf8(column)
    raw = LOWER[raw]
    starts, ends, counts = word_spans(raw, offsets, NON_SPACE)
    hashes = np.full(len(starts) + len(counts), END, _U)
    row = np.repeat(np.arange(len(counts)), counts)
    hashes[np.arange(len(starts)) + row] = word_hashes(raw, starts, ends)
    words, ids = np.unique(hashes, return_inverse=True)
    return words, ids.astype(np.int32), counts + 1


def contexts(ids: np.ndarray, end: int) -> np.ndarray:
    """Word number before each token; rows follow an end, as does the first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[:1] = end
    return before


def owners_of(hashes: np.ndarray, owners: int, bits: int) -> list[int]:
    """First place of each owner's range among sorted hashes, and the end."""
    return np.searchsorted(hashes, np.array([(k << bits) // owners for k in range(owners)], dtype=_U)).tolist() + [len(hashes)]


def _counted(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values, ascending, with their counts in counted and in left-out texts."""
    key = (values.astype(np.int64) << 2) | of
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] >> 2 != key[:-1] >> 2])) if len(key) else np.zeros(0, np.int64)
    low = (key & 3).astype(np.uint8)
    add = lambda role: np.add.reduceat((low == role).astype(np.int32), first) if len(first) else np.zeros(0, np.int32)
    return key[first] >> 2, add(MAIN), add(APART)


def _messages(number: int, kind: int, hashes: np.ndarray, main: np.ndarray, apart: np.ndarray, owners: int, bits: int) -> list[tuple]:
    cut = owners_of(hashes, owners, bits)
    return [(number, kind, k, pack(np.diff(hashes[a:b], prepend=_U(0)), main[a:b].astype(np.int64), apart[a:b].astype(np.int64))) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def _blocks(batches, owners: int, ask: bool):
    """Messages to owners, or the blocks' own rows, from (id, text, role) batches."""
    number = TaskContext.get().partitionId() << 24
    for batch in gathered(batches, 1, BLOCK_BYTES):
        _, offsets = utf8(batch.column(1))
        for a, b in steps(offsets, BLOCK_BYTES + BLOCK_BYTES // 2):
            words, ids, counts = tokens(batch.column(1).slice(a, b - a))
            role = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.uint8)
            if ask:
                # Sorted with the role in the low bits, so that counts need no inverse.
                of = np.repeat(role, counts)
                pairs = contexts(ids, int(np.searchsorted(words, END))).astype(np.int64) * len(words) + ids
                rows = _messages(number, 0, words, *_counted(ids, of)[1:], owners, 64)
                pairs, main, apart = _counted(pairs, of)
                del ids, of
                hashes = _pair_hash(words >> _U(WORD_SHIFT), pairs)
                del pairs
                order = np.argsort(hashes)
                rows += _messages(number, 1, hashes[order], main[order], apart[order], owners, 64 - PAIR_SHIFT)
                del hashes, order, main, apart
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "kind", "owner", "payload"])
            else:
                lists = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a))
                payload = pack(counts.astype(np.int64), role, np.diff(words >> _U(WORD_SHIFT), prepend=_U(0)), ids.astype(np.int64), np.searchsorted(words, [END]))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([2], pa.int32()), pa.array([0], pa.int32()), pa.array([payload], pa.binary()), pa.array([0], pa.int64()), lists], names=["block", "kind", "owner", "payload", "fresh", "ids"])
            number += 1


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals for every block that asked, in its own order.

    ``fresh`` counts the different words with training counts of which the
    block is the first to ask, so that the blocks' sum is the vocabulary.
    """
    pdf = pdf.sort_values("block", ignore_index=True)
    asked = [unpack(x) for x in pdf["payload"]]
    sizes = [len(x[0]) for x in asked]
    hashes = np.concatenate([np.cumsum(x[0], dtype=_U) for x in asked])
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    main = np.bincount(which, np.concatenate([x[1] for x in asked])).astype(np.int64)
    apart = np.bincount(which, np.concatenate([x[2] for x in asked])).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    new = np.bincount(np.searchsorted(starts, first[main + apart > 0], side="right") - 1, minlength=len(sizes))
    payload = [pack(main[which[a:b]], apart[which[a:b]]) for a, b in zip(starts, starts[1:])]
    return pd.DataFrame({"block": pdf["block"], "kind": pdf["kind"], "owner": pdf["owner"], "payload": payload, "fresh": new})


def _scale(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.rint(FINE * np.log2(np.maximum(x, 1e-300))), ZERO).astype(np.int64)


def bucket(count: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 for unseen, else by powers of two."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _totals(parts: list[np.ndarray]) -> np.ndarray:
    """Totals in one array, of 32 bits only where the sum of two of them fits too."""
    kind = np.int32 if all(x.max(initial=0) < 1 << 30 for x in parts) else np.int64
    return np.concatenate([x.astype(kind) for x in parts])


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block with its answers: counts at every token, and the EM histogram."""
    own = pdf[pdf["kind"] == 2].iloc[0]
    counts, role, words, ids, end = unpack(own["payload"])
    words, end = np.cumsum(words, dtype=_U), int(end[0])
    answers = pdf[pdf["kind"] != 2].sort_values(["kind", "owner"])
    del pdf
    totals = []
    for kind in (0, 1):
        got = [unpack(x) for x in answers.loc[answers["kind"] == kind, "payload"]]
        totals.append([_totals([x[j] for x in got]) for j in (0, 1)])
        del got
    fresh = int(answers.loc[answers["kind"] == 0, "fresh"].sum())
    del answers
    ids = ids.astype(np.int32)
    pairs, which = np.unique(contexts(ids, end).astype(np.int64) * len(words) + ids, return_inverse=True)
    which = which.astype(np.int32)
    if len(pairs) != len(totals[1][0]) or len(words) != len(totals[0][0]):
        raise RuntimeError("the documents changed between two readings; write them to a table first")
    order = np.argsort(_pair_hash(words, pairs))
    del pairs
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    del order
    at = place[which]
    del place, which
    main2, apart2 = (x[at] for x in totals[1])
    main1, apart1 = totals[0]
    apart = np.repeat(role, counts) == APART
    context, pair, word = main1[contexts(ids, end)[apart]], main2[apart], main1[ids[apart]]
    cells = np.column_stack([bucket(context), _scale(pair / np.maximum(context, 1)), _scale(word)])
    cells, n = np.unique(cells, axis=0, return_counts=True)
    trained = int(counts[role != SCORED].sum())
    counted = int(counts[role == MAIN].sum())
    payload = pack(counts.astype(np.int64), role, ids.astype(np.int64), (main1 + apart1).astype(np.int64), (main2 + apart2).astype(np.int64), np.array([end]))
    return pd.DataFrame({"block": [own["block"]], "ids": [own["ids"]], "payload": [payload], "fresh": [fresh], "trained": [trained], "counted": [counted], "cells": [[(*map(int, c), int(k)) for c, k in zip(cells, n)]]})


def learn(cells: list[tuple[int, int, int, int]], counted: int, vocabulary: int, rounds: int = 60) -> dict[int, tuple[float, float, float]]:
    """Weights of bigram, unigram and floor for each bucket, by EM on held-out counts."""
    default = (0.0, 0.7, 0.3)
    out: dict[int, tuple[float, float, float]] = {}
    by: dict[int, list] = {}
    for b, q2, q1, n in cells:
        by.setdefault(b, []).append((q2, q1, n))
    for b, rows in sorted(by.items()):
        q2, q1, n = (np.array(x, dtype=float) for x in zip(*sorted(rows)))
        p = np.column_stack([np.where(q2 == ZERO, 0, 2 ** (np.minimum(q2, 0) / FINE)), np.where(q1 == ZERO, 0, 2 ** (np.where(q1 == ZERO, 0, q1) / FINE) / max(counted, 1)), np.full(len(n), 1 / (vocabulary + 1))])
        w = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.7, 0.3])
        for _ in range(rounds):
            share = p * w
            share *= (n / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) / n.sum()
        floor = np.array([0.0, 0.0, 1e-6])  # an unknown word keeps some probability
        w = (w + floor) / (w + floor).sum()
        out[b] = tuple(map(float, w))
    last = default
    for b in range(64):  # buckets without held-out tokens take the nearest below
        last = out.setdefault(b, last)
    return out


def score(docs: DataFrame, trained_on: Column, apart: Column, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``trained_on`` marks the rows that are learned from, ``apart`` those of them
    that the mixture weights are learned on. ``docs`` is read twice and must
    give the same rows in the same partitions, as a scan of files does; a
    mismatch raises an error.
    """
    spark = ship(docs.sparkSession)
    owners = owners or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    role = F.when(~F.coalesce(trained_on, F.lit(False)), SCORED).when(F.coalesce(apart, F.lit(False)), APART).otherwise(MAIN)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), role.cast("int").alias("role"))
    kind = dict(docs.dtypes)[id_col]
    asked = rows.mapInArrow(lambda it: _blocks(it, owners, True), "block long, kind int, owner int, payload binary")
    answers = asked.groupBy("kind", "owner").applyInPandas(_answer, "block long, kind int, owner int, payload binary, fresh long")
    own = rows.mapInArrow(lambda it: _blocks(it, owners, False), f"block long, kind int, owner int, payload binary, fresh long, ids array<{kind}>")
    both = own.unionByName(answers.withColumn("ids", F.lit(None).cast(f"array<{kind}>")))
    merged = both.groupBy("block").applyInPandas(_merged, f"block long, ids array<{kind}>, payload binary, fresh long, trained long, counted long, cells array<struct<b:int,p2:int,p1:int,n:long>>")
    merged = checkpointed(merged)
    vocabulary, total, counted = (x or 0 for x in merged.agg(F.sum("fresh"), F.sum("trained"), F.sum("counted")).first())
    cells = merged.select(F.explode("cells").alias("c")).groupBy("c.b", "c.p2", "c.p1").agg(F.sum("c.n").alias("n"))
    mixture = learn([tuple(r) for r in cells.collect()], counted, vocabulary)
    table = np.array([mixture[b] for b in range(64)])

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for ids_list, payload in zip(batch.column(0), batch.column(1)):
                counts, role, ids, uni, pair, end = unpack(payload.as_py())
                ids = ids.astype(np.int32)
                context = uni[contexts(ids, int(end[0]))].astype(np.int64)
                c = uni[ids].astype(np.int64)
                w = table[bucket(context)]
                p = w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (c / max(total, 1)) + w[:, 2] / (vocabulary + 1)
                cut = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                out[0].append(ids_list.values)
                out[1].append(role == SCORED)
                out[2].append(counts.astype(np.int64))
                out[3].append(np.add.reduceat((c > 0).astype(np.int64), cut))
                out[4].append(np.full(len(counts), total))
                out[5].append(np.add.reduceat(np.log10((c + 1) / (total + vocabulary + 1)), cut))
                out[6].append(np.add.reduceat(np.log10(p), cut))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out[0]), *(pa.array(np.concatenate(x)) for x in out[1:])], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return merged.select("ids", "payload").mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


