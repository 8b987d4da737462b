"""Quality scores: ridge regression on random Fourier features of document statistics.

Random Fourier features approximate a Gaussian kernel over the standardised statistics of a text.  Each partition of
the labelled sample sums its part of the normal equations, by fold; their sums are solved on the driver (a matrix of
``features`` squared, whatever the input).  Scores of the folds left out give the isotonic calibration.
"""

from __future__ import annotations

import math
import operator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch, chunks, free_name
from quaystone.llm.labelled import Isotonic, held_out, own_fold, training_sample

#: Labelled rows to fit on, at most about so many.
SAMPLE = 20_000
FEATURES, GAMMA, RIDGE, INNER = 256, 0.03, 3.0, 3
#: How the contract splits rows and cuts scores.
FOLDS, HELD, CUT = 5, 0, 0.3

_CLASSES = np.zeros((8, 256))
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"?!()-", b"#$%&*@~^_=+<>/\\|{}[]`", b"|", b"!")):
    _CLASSES[_i, list(_chars)] = 1
_MARKUP = re.compile(rb"[<{\[][^>}\]\n]{0,80}[>}\]]")


def statistics(text: bytes) -> list[float]:
    """Figures about a text; all are finite, for an empty text too."""
    words = text.split()
    n, chars = len(words), len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (_CLASSES @ counts) / max(chars, 1)
    p = counts[counts > 0] / max(chars, 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lower = text.lower().split()
    unique = len(set(lower))
    lines = text.split(b"\n")
    stripped = [x for x in map(bytes.strip, lines) if x]
    repeats = sum(map(operator.eq, lower, lower[1:]))
    pairs = len(set(zip(lower, lower[1:], strict=False)))
    ends = sum(w[-1:] in b"#$%&*!|" for w in words)
    return [
        math.log1p(chars), math.log1p(n), lengths.mean() if n else 0.0, lengths.std() if n else 0.0, math.log1p(lengths.max()) if n else 0.0,
        *shares, (counts[128:].sum()) / max(chars, 1), float(-(p * np.log(p)).sum()),
        unique / max(n, 1), unique / max(n, 1) ** 0.8, pairs / max(n - 1, 1), repeats / max(n, 1), ends / max(n, 1),
        math.log1p(len(lines)), len(set(stripped)) / max(len(stripped), 1), math.log1p(chars / len(lines)),
        sum(1 for w in words if w.isupper()) / max(n, 1), sum(1 for w in words if w[:1].isupper()) / max(n, 1), len(_MARKUP.findall(text)) / max(n, 1),
    ]


class Kernel:
    """Standardised statistics to random Fourier features, with the statistics themselves and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, gamma: float = GAMMA, seed: int = 17):
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        r = np.random.RandomState(seed)
        self.w = r.normal(0, math.sqrt(2 * gamma), (len(mean), features))
        self.b = r.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b)), z / 6, np.ones((len(z), 1))], 1)


def _measure(batches):
    for batch in chunks(batches):
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))}
        )


def _equations(batches, kernel: Kernel):
    """A partition's sums of z'z, z'y for each fold, one row for each fold."""
    sums: dict[int, list] = {}
    for batch in batches:
        x = np.array(batch.column("x").to_pylist())
        if not len(x):
            continue
        z, y = kernel(x), batch.column("y").to_numpy().astype(float)
        fold = np.array([own_fold(d, INNER) for d in batch.column("doc_id").to_pylist()])
        for f in np.unique(fold):
            a, b = z[fold == f], y[fold == f]
            s = sums.setdefault(int(f), [0, 0])
            s[0] = s[0] + a.T @ a
            s[1] = s[1] + a.T @ b
    if sums:
        yield pa.RecordBatch.from_pydict({"fold": pa.array(list(sums), pa.int32()), "zz": pa.array([s[0].tobytes() for s in sums.values()], pa.binary()), "zy": pa.array([s[1].tobytes() for s in sums.values()], pa.binary())})


class QualityModel:
    """Kernel, ridge weights and calibration."""

    def __init__(self, kernel: Kernel, weights: np.ndarray, calibrate: Isotonic):
        self.kernel, self.weights, self.calibrate = kernel, weights, calibrate

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.calibrate(self.kernel(np.array([statistics(t or b"") for t in texts])) @ self.weights)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held: int = HELD) -> QualityModel:
    """Learns from at most about ``sample`` labelled rows outside the held-out fold; without any, every score is 0.5."""
    scratch = Scratch(docs.sparkSession)
    rows = training_sample(docs, labels, "quality", folds, held, sample)
    rows = scratch.keep(rows.mapInArrow(_measure, "doc_id long, y int, x array<double>"), "measured")
    # the sample is bounded, and so are these: a mean and deviation for each statistic, and few partitions
    width = len(statistics(b""))
    means = rows.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if means["m0"] is None:
        kernel = Kernel(np.zeros(width), np.ones(width))
        return QualityModel(kernel, np.zeros(FEATURES + width + 1), Isotonic(np.zeros(0), np.zeros(0)))
    kernel = Kernel(np.array([means[f"m{i}"] for i in range(width)]), np.array([means[f"s{i}"] for i in range(width)]))
    size = FEATURES + width + 1
    parts = rows.coalesce(4).mapInArrow(lambda bs: _equations(bs, kernel), "fold int, zz binary, zy binary").collect()
    zz, zy = np.zeros((INNER, size, size)), np.zeros((INNER, size))
    for p in parts:
        zz[p["fold"]] += np.frombuffer(p["zz"]).reshape(size, size)
        zy[p["fold"]] += np.frombuffer(p["zy"])
    ridge = RIDGE * np.eye(size)
    ridge[-1, -1] = 1e-6
    solve = lambda a, b: np.linalg.solve(a + ridge, b)
    without = [solve(zz.sum(0) - zz[f], zy.sum(0) - zy[f]) for f in range(INNER)]
    measured = rows.select("doc_id", "y", "x").toPandas()  # bounded by ``sample``
    z = kernel(np.array(measured["x"].tolist()))
    fold = np.array([own_fold(d, INNER) for d in measured["doc_id"]])
    raw = (z * np.array(without)[fold]).sum(1)
    scratch.drop("measured")
    return QualityModel(kernel, solve(zz.sum(0), zy.sum(0)), Isotonic(raw, measured["y"].to_numpy()))


def _score(batches, model: QualityModel, keep_from: float | None, texts: str = "_bytes"):
    for batch in chunks(batches):
        scores = model.scores(batch.column(texts).to_pylist())
        if keep_from is None:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(scores)})
        else:
            yield batch.filter(pa.array(scores >= keep_from)).drop_columns([texts])


def score_quality(docs: DataFrame, model: QualityModel, folds: int = FOLDS, held: int = HELD, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null text scores as an empty one; repeated rows score alike."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_bytes"))
    out = rows.mapInArrow(lambda bs: _score(bs, model, None), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: QualityModel, cut: float = CUT) -> DataFrame:
    """Rows of ``docs``, all columns, whatever their names, whose score is ``cut`` or more."""
    name = free_name(docs.columns, "_bytes")
    return docs.withColumn(name, F.col("text").cast("binary")).mapInArrow(lambda bs: _score(bs, model, cut, name), docs.schema)
