"""Labelled rows to learn from, and calibration."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_crc(doc_id: Column) -> Column:
    """crc32 of doc_id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_fold: int, bound: int) -> DataFrame:
    """doc_id, text (binary), y of at most ``bound`` labelled rows outside the held-out fold.

    Rows without a doc_id, text or label are left out; of several labels of a document the largest counts.  The labelled
    ids of smallest hash are taken, and of their rows, which may be any number, those of smallest hash: the same in every
    run, exact for any number of labels, and never more than ``bound`` rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) != held_fold).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(bound)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null and text is not null")
    # ``bound`` ids at most, so theirs is the side to send; the rows are dealt out again after the limit
    found = text.join(F.broadcast(known), "doc_id")
    return found.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(bound).repartition("doc_id")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the row is in the fold that nothing is learnt from; a null doc_id is not."""
    return F.coalesce(F.pmod(id_crc(doc_id), F.lit(folds)) == fold, F.lit(False))


def own_fold(doc_id: int, folds: int) -> int:
    """A second split of the training rows, independent of the held-out one."""
    return zlib.crc32(b"fold:%d" % doc_id) % folds


class Isotonic:
    """Non-decreasing map from raw scores to shares of label 1, by pool adjacent violators."""

    def __init__(self, raw: np.ndarray, y: np.ndarray, prior: float = 1.0):
        # equal raw scores are one point
        points, at = np.unique(np.asarray(raw, float), return_inverse=True)
        ones, rows = np.bincount(at, np.asarray(y, float), len(points)), np.bincount(at, minlength=len(points))
        blocks: list[list[float]] = []  # sum of y, rows, lowest and highest raw score
        for x, v, n in zip(points, ones, rows, strict=True):
            blocks.append([v, float(n), x, x])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                top = blocks.pop()
                blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2], top[3]]
        share = float(np.mean(y)) if len(y) else 0.5
        knots = [(x, (b[0] + prior * share) / (b[1] + prior)) for b in blocks for x in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
        self.x = np.array([k for k, _ in knots] or [0.0])
        self.y = np.maximum.accumulate(np.array([v for _, v in knots] or [share]))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)
