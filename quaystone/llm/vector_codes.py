"""Product codes of vectors by Hamerly's form of Lloyd's algorithm on integers.

A vector's components become integers and are cut into parts, each with a codebook of its own.  Every part carries its
entry, an upper bound of its distance to that entry and one lower bound of its distance to the second nearest; they are
stored with the vector from round to round.  After the entries moved, a part whose upper bound is strictly under its lower
bound (or under half the gap around its entry) keeps its entry without a look at the others: no other entry can be
nearer, or as near, so ties are never decided by a bound.  Else the upper bound is made exact, and if that doesn't do,
all entries are compared in exact integers, the lower index first.

Rounds are jobs over a stored table; what meets on the driver is a sum for each entry of each codebook, of fixed number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch, chunks, salted_left_join

#: The scale of components, and how many parts, entries and rounds the contract has.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components of more than so many units can't be summed and squared exactly in 64 bits.
LARGEST = 2**26
ROWS = 2048
_STATE = "vec_id long, label {label}, x binary, entry binary, upper binary, lower binary"


def _up(x):
    return x * (1 + 1e-12)


def _down(x):
    return x * (1 - 1e-12)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to all entries of a codebook."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 2**53:  # integers that floats hold exactly, in any order of the sums
        a, b = x.astype(float), book.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - book[None, :, i]) ** 2
    return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (lower index first), upper bound of its distance, lower bound of the second nearest's."""
    d = squares(x, book)
    entry = d.argmin(1)
    at = np.arange(len(x))
    upper = _up(np.sqrt(d[at, entry].astype(float)))
    d[at, entry] = np.iinfo(np.int64).max
    lower = _down(np.sqrt(d.min(1).astype(float))) if len(book) > 1 else np.full(len(x), np.inf)
    return entry, upper, lower


def reassign(x: np.ndarray, book: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries moved by at most ``moved`` each, from the bounds before; and how many rows were compared
    with all entries."""
    if len(book) < 2:
        return entry, _up(upper + moved[entry]), lower, 0
    far = np.argsort(moved)[-2:]
    others = np.where(entry == far[1], moved[far[0]], moved[far[1]])
    upper, lower = _up(upper + moved[entry]), np.maximum(lower - others, 0)
    lower = np.minimum(_down(lower), lower)
    gaps = squares(book, book)
    np.fill_diagonal(gaps, np.iinfo(np.int64).max)
    gap = _down(np.sqrt(gaps.min(1).astype(float)) / 2)
    safe = np.maximum(lower, gap[entry])
    open_ = np.flatnonzero(~(upper < safe))
    own = ((x[open_] - book[entry[open_]]) ** 2).sum(1)
    upper[open_] = _up(np.sqrt(own.astype(float)))
    open_ = open_[~(upper[open_] < safe[open_])]
    entry = entry.copy()
    if len(open_):
        entry[open_], upper[open_], lower[open_] = scan(x[open_], book)
    return entry, upper, lower, len(open_)


def _start(batches, width: int):
    """Vectors as integers, without entry or bounds; shorter ones are filled up with zeros."""
    for batch in chunks(batches, ROWS):
        lists = batch.column("embedding")
        values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(float))
        if np.abs(values).max(initial=0) > LARGEST:
            raise ValueError(f"a component is beyond {LARGEST // SCALE}: sums of squares would not be exact")
        n = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        x = np.zeros((len(n), width), np.int32)
        x[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
        empty = pa.array([b""] * len(n), pa.binary())
        yield _state(batch, x, [empty] * 3)


def _state(batch, x, rest) -> pa.RecordBatch:
    xs = pa.array([row.tobytes() for row in x], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), xs, *rest], ["vec_id", "label", "x", "entry", "upper", "lower"])


def _matrix(column, dtype, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _assigned(batches, shared):
    """(batch, integers, entries, upper, lower) after an assignment to the codebooks."""
    books, moved = shared.value
    parts, _, width = books.shape
    for batch in chunks(batches, ROWS):
        x = _matrix(batch.column("x"), np.int32, parts, width)
        entry = np.zeros((len(x), parts), np.int64)
        upper, lower = np.zeros((len(x), parts)), np.zeros((len(x), parts))
        if moved is not None:
            entry[:] = _matrix(batch.column("entry"), np.uint8, parts)
            upper[:], lower[:] = (_matrix(batch.column(c), np.float64, parts) for c in ("upper", "lower"))
        for p in range(parts):
            part = x[:, p].astype(np.int64)
            if moved is None:
                entry[:, p], upper[:, p], lower[:, p] = scan(part, books[p])
            else:
                entry[:, p], upper[:, p], lower[:, p], _ = reassign(part, books[p], entry[:, p], upper[:, p], lower[:, p], moved[p])
        yield batch, x, entry, upper, lower


def _round(batches, shared):
    for batch, x, entry, upper, lower in _assigned(batches, shared):
        yield _state(batch, x, [pa.array([row.tobytes() for row in m], pa.binary()) for m in (entry.astype(np.uint8), upper, lower)])


def _sums(batches, parts: int, entries: int, width: int):
    """For each part and used entry, the number of a task's parts and their sum."""
    n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
    for batch in chunks(batches, ROWS):
        x = _matrix(batch.column("x"), np.int32, parts, width).astype(np.int64)
        entry = _matrix(batch.column("entry"), np.uint8, parts) + np.arange(parts) * entries
        n += np.bincount(entry.ravel(), minlength=len(n))
        np.add.at(sums, entry.ravel(), x.reshape(-1, width))
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_pydict({"at": pa.array(used), "n": pa.array(n[used]), "s": pa.array(sums[used].tolist(), pa.list_(pa.int64()))})


def _codes(batches, shared):
    books = shared.value[0]
    for batch, x, entry, _, _ in _assigned(batches, shared):
        own = books[np.arange(len(books))[None, :], entry]
        error = ((x.astype(np.int64) - own) ** 2).sum((1, 2))
        code = pa.array([row.tobytes() for row in entry.astype(np.uint8)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array(error)], ["vec_id", "label", "code", "error"])


def moved_entries(books: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks whose used entries are the floors of their parts' means, and upper bounds of how far each entry moved."""
    new = books.copy()
    for at, (n, s) in sums.items():
        new[divmod(at, books.shape[1])] = [x // n for x in s]
    return new, _up(np.sqrt(((new - books) ** 2).sum(2).astype(float)))


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code: a byte for each part, error) of the kept rows of ``vectors``, a stored table, and the codebooks
    (part, entry, position).

    Rows whose vector is null or holds a null, NaN or infinity are dropped.  The first codebooks are the rows of smallest
    vec_id; of one vec_id, the smaller vector comes first, and a null vec_id last; of fewer rows than ``entries``, each is an
    entry.  Repeated rows are coded each.  Vectors shorter than the longest, or whose length the parts don't divide, end in
    zeros.  Components beyond 65,536 are an error.  An empty table gives no rows and codebooks without entries.
    """
    if entries > 256:
        raise ValueError("an entry's index is a byte")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(F.col("embedding").isNotNull() & sound)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts)
    label = dict(kept.dtypes)["label"]
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()  # ``entries`` rows
    seeds = np.zeros((len(first), parts * width), np.int64)
    for row, r in zip(seeds, first, strict=True):
        row[: len(r["embedding"])] = np.floor(SCALE * np.array(r["embedding"], float))
    books, moved = np.ascontiguousarray(seeds.reshape(len(first), parts, width).transpose(1, 0, 2)), None
    schema = _STATE.format(label=label)
    state = scratch.keep(kept.mapInArrow(lambda bs: _start(bs, parts * width), schema), "state-0")
    for r in range(rounds if len(first) else 0):
        shared = spark.sparkContext.broadcast((books, moved))
        state = scratch.keep(state.mapInArrow(lambda bs, s=shared: _round(bs, s), schema), f"state-{r + 1}")
        scratch.drop(f"state-{r}")
        k = books.shape[1]
        part = state.select("x", "entry").mapInArrow(lambda bs, k=k: _sums(bs, parts, k, width), "at long, n long, s array<long>")
        total = part.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
        books, moved = moved_entries(books, {t["at"]: (t["n"], t["s"]) for t in total.collect()})  # a row for each entry
        shared.unpersist()
    shared = spark.sparkContext.broadcast((books, moved))
    codes = scratch.keep(state.mapInArrow(lambda bs: _codes(bs, shared), f"vec_id long, label {label}, code binary, error long"), "codes")
    scratch.drop(f"state-{rounds if len(first) else 0}")
    return codes, books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` and label_error, the error summed over rows of an equal label, null being one.  A label may hold any share
    of the rows: they are summed before they are shuffled, and joined in shares."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("_key")
    total = codes.select(key, "error").groupBy("_key").agg(F.sum("error").alias("label_error"))
    return salted_left_join(codes.select("*", key), total, "_key", "vec_id").drop("_key")


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode_vectors(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and the vector that a code stands for, in the unit of the input."""
    shared = codes.sparkSession.sparkContext.broadcast(books)
    return codes.select("vec_id", "code").mapInArrow(lambda bs: _decoded(bs, shared), "vec_id long, embedding array<double>")


def _decoded(batches, shared):
    books = shared.value
    for batch in chunks(batches, ROWS):
        entry = _matrix(batch.column("code"), np.uint8, len(books))
        x = books[np.arange(len(books))[None, :], entry].reshape(len(entry), -1) / SCALE
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(x), pa.list_(pa.float64()))], ["vec_id", "embedding"])
