"""Toxicity by the nearest labelled examples under exact weighted TF-IDF cosine, with a block-max inverted index.

Terms are lower-cased words without punctuation around them, and their first bytes, by 64-bit hash.  A term weighs its
inverse document frequency over the whole corpus times a power of one plus its likelihood ratio for label 1, so none is
left out and those that tell label 1 count most.  The power, how many examples vote and how much nearer ones count more
are chosen by folds inside the training rows.

The index holds every term of a bounded sample of examples.  Postings by term give each example's score from all but the
most frequent terms.  Those are matrices by block of examples, with each term's largest weight in the block: a block
whose bound stays under the k-th best is passed over.

A text's vector has all its terms.  Those that no example holds meet none, so they change no order among the examples but
the length of the vector: they are joined with the corpus' counts by term, and their squares summed by text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch, id_out, mix, ranges, signed, with_ids
from quaystone.llm.labelled import Isotonic, held_out, training_sample

#: Labelled rows in the index, at most; rows and bytes of text taken at a time.
SAMPLE, ROWS, BYTES = 4000, 256, 2_000_000
#: A term that one in so many examples holds is in the blocks' matrices; examples of a block; queries taken at a time.
DENSE, BLOCK, QUERIES, CACHED = 16, 64, 128, 8
#: How the contract splits rows and cuts scores.
FOLDS, HELD, CUT = 3, 1, 0.7
_AROUND = b".,;:!?\"'()[]{}<>*#$%&|-_"
_STEMS = (5,)
#: What is chosen from: powers of the likelihood ratio, numbers of neighbours that vote, slacks of ``votes``; and folds of
#: the training rows to choose by.
POWERS, NEIGHBOURS, SLACKS, INNER = (0.25, 0.5, 0.75), (5, 15, 30), (0.05, 0.2, 0.8), 3
#: Terms that a task holds before it hands their counts over; squares are summed in units of 2**-20, in any order.
HELD_TERMS, SQUARE = 2_000_000, 2**20


def terms_of(word: bytes) -> tuple[bytes, ...]:
    """The terms of a word: itself, and marked as such its first bytes, as far as it has so many."""
    word = word.strip(_AROUND)
    return (word, *(b"^" + word[:k] for k in _STEMS if len(word) >= k)) if word else ()


def term_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``terms_of`` each word, a column for the word and one for each length of a stem, and which of them there
    are.  Words are read eight bytes at a time from their buffer; no object is made of a word."""
    words = pc.ascii_trim(words, characters=_AROUND.decode())
    start = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = words.buffers()[2]
    data = np.concatenate([np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    start, size = start[:-1], np.diff(start)
    cut = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
    first = eight[start] & cut[np.minimum(size, 8)]
    out = np.empty((len(words), 1 + len(_STEMS)), np.uint64)
    for j, k in enumerate(_STEMS, 1):
        out[:, j] = mix((first & cut[k]) ^ np.uint64(k * 0x9FB21C651E98DF25 % 2**64))
    whole = mix(first ^ (size.astype(np.uint64) << np.uint64(56)))
    longer = np.flatnonzero(size > 8)
    at = 8
    while len(longer):
        whole[longer] = mix(whole[longer] * np.uint64(0xD6E8FEB86659FD93) ^ (eight[start[longer] + at] & cut[np.minimum(size[longer] - at, 8)]))
        at += 8
        longer = longer[size[longer] > at]
    out[:, 0] = whole
    return out, size[:, None] >= np.array([1, *_STEMS])


def _pieces(batches):
    """Smaller record batches, by rows and by bytes of text, so that a worker's arrays stay small."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = min(max(int(np.searchsorted(size, done + BYTES, "right")), at + 1), at + ROWS)
            yield batch.slice(at, end - at)
            at = end


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, occurrences) of the terms of texts, by text and code; and the hash that each code stands for, ascending."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.view(pa.string()), "")))
    coded = split.values.dictionary_encode()
    hashed, real = term_hashes(coded.dictionary)
    hashes, code = np.unique(hashed[real], return_inverse=True)
    of = real.sum(1)
    row = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    pair, n = np.unique(row * (len(of) + 1) + coded.indices.to_numpy(), return_counts=True)
    row, word = np.divmod(pair, len(of) + 1)
    code = code[ranges((np.cumsum(of) - of)[word], of[word])]
    # words that differ in punctuation, or after their first bytes, have a term in common
    pair = np.repeat(row, of[word]) * (len(hashes) + 1) + code
    order = np.argsort(pair)
    pair, n = pair[order], np.repeat(n, of[word])[order]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else pair
    row, code = np.divmod(pair[first], len(hashes) + 1)
    return row, code, np.add.reduceat(n, first) if len(first) else n, hashes


def _find(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of ``hashes`` in the ascending ``known``, -1 for none."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def own_text_fold(text: bytes | None) -> int:
    """The inner fold of an example; copies of a text are in one."""
    return zlib.crc32(b"fold:" + (text or b"")) % INNER


def _sample_terms(batches):
    """Terms of the sample's documents, by hash and inner fold, with counts by label, summed within each batch."""
    for batch in _pieces(batches):
        y = batch.column("y").to_numpy()
        fold = np.array([own_text_fold(t) for t in batch.column("text").to_pylist()], np.int64)
        row, code, _, hashes = counted(batch.column("text"))
        key, at = np.unique(code * INNER + fold[row], return_inverse=True)
        n1 = np.bincount(at, y[row], len(key)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"term": pa.array(signed(hashes[key // INNER])), "fold": pa.array((key % INNER).astype(np.int32)), "n0": pa.array(np.bincount(at, minlength=len(key)) - n1), "n1": pa.array(n1)})


def _corpus_terms(batches):
    """Terms of all documents with the number of documents that hold them, summed within a task."""

    def total(parts):
        terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        return terms, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows(parts):
        terms, n = total(parts)
        return pa.RecordBatch.from_pydict({"term": pa.array(signed(terms)), "n": pa.array(n)})

    parts, held = [], 0
    for batch in _pieces(batches):
        _, code, _, hashes = counted(batch.column("text"))
        parts.append((hashes, np.bincount(code, minlength=len(hashes))))
        held += len(hashes)
        if held > HELD_TERMS:
            parts = [total(parts)]
            held = len(parts[0][0])
            if held > HELD_TERMS // 2:
                yield rows(parts)
                parts, held = [], 0
    if parts:
        yield rows(parts)


def _example_counts(batches, shared):
    for batch in _pieces(batches):
        row, code, n, hashes = counted(batch.column("text"))
        cut = np.searchsorted(row, np.arange(1, batch.num_rows))
        packed = [[x.tobytes() for x in np.split(v, cut)] for v in (_find(shared.value, hashes)[code].astype(np.int32), n.astype(np.int64))]
        fold = [own_text_fold(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "fold": pa.array(fold, pa.int32()), "numbers": pa.array(packed[0], pa.binary()), "counts": pa.array(packed[1], pa.binary())})


class BlockMaxIndex:
    """Unit vectors of the examples: postings by term, and for the terms that many hold matrices by block of examples."""

    def __init__(self, terms, idf: np.ndarray, ids: np.ndarray, y: np.ndarray, numbers: list, counts: list):
        self.terms, self.idf = terms, idf.astype(np.float32)
        size = np.array([len(x) for x in numbers], np.int64)
        row = np.repeat(np.arange(len(ids), dtype=np.int32), size)
        number = np.concatenate([np.asarray(x, np.int32) for x in numbers]) if len(ids) else np.zeros(0, np.int32)
        n = np.concatenate([np.asarray(x, np.float32) for x in counts]) if len(ids) else np.zeros(0, np.float32)
        weight = self.unit(row, number, n, len(ids))
        self.lengths = np.bincount(number, minlength=len(terms))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.column = np.full(len(terms), -1)
        often = np.flatnonzero(self.lengths * DENSE >= max(len(ids), 1))
        self.column[often] = np.arange(len(often))
        # examples whose heaviest frequent term is the same stand together, so that the bounds of blocks are close
        theme = np.full(len(ids), -1)
        heavy = np.flatnonzero(self.column[number] >= 0)
        heavy = heavy[np.lexsort((number[heavy], weight[heavy]))]
        theme[row[heavy]] = number[heavy]
        order = np.lexsort((ids, y, theme))
        self.ids, self.y = ids[order], y[order].astype(np.float32)
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids))
        row = place[row]
        by = np.lexsort((row, number))
        self.row, self.weight = row[by], weight[by]
        self.copies = int(np.unique(ids, return_counts=True)[1].max(initial=0))
        self.blocks = None

    def __getstate__(self):
        return self.__dict__ | {"blocks": None}  # made anew from the postings

    def _matrices(self):
        held = self.column[np.repeat(np.arange(len(self.lengths)), self.lengths)]
        dense = np.zeros((self.column.max(initial=-1) + 1, len(self.ids)), np.float32)
        dense[held[held >= 0], self.row[held >= 0]] = self.weight[held >= 0]
        self.edges = np.arange(0, len(self.ids), BLOCK)
        self.blocks = [np.ascontiguousarray(dense[:, a : a + BLOCK]) for a in self.edges]
        self.most = np.stack([b.max(1, initial=0) for b in self.blocks], 1)

    def unit(self, row: np.ndarray, number: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        """Counts to the weights of unit vectors; a vector without known terms stays zero."""
        w = np.log1p(n).astype(np.float32) * self.idf[number]
        return w / np.maximum(np.sqrt(np.bincount(row, w.astype(float) ** 2, rows)), 1e-12).astype(np.float32)[row]

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """The same for a matrix of counts."""
        row, number = np.nonzero(counts)
        out = np.zeros(counts.shape, np.float32)
        out[row, number] = self.unit(row, number, counts[row, number], len(counts))
        return out

    def _cosines(self, row: np.ndarray, number: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
        """Cosines of n queries with all examples; -1 in blocks that can't reach a query's k nearest."""
        if self.blocks is None:
            self._matrices()
        column = self.column[number]
        often = column >= 0
        query = np.zeros((n, len(self.most)), np.float32)
        query[row[often], column[often]] = weight[often]
        row, number, weight = row[~often], number[~often], weight[~often]
        score = np.empty((n, len(self.ids)), np.float32)
        for q in range(0, n, CACHED):  # so few that their scores and postings stay in the cache
            a, b = np.searchsorted(row, (q, q + CACHED))
            lengths = self.lengths[number[a:b]]
            at = ranges(self.starts[number[a:b]], lengths)
            part = np.bincount(np.repeat((row[a:b] - q) * len(self.ids), lengths) + self.row[at], np.repeat(weight[a:b], lengths) * self.weight[at], min(CACHED, n - q) * len(self.ids))
            score[q : q + CACHED] = part.reshape(-1, len(self.ids))
        best = np.maximum.reduceat(score, self.edges, axis=1)
        # the k-th best block by postings alone is a lower bound of the k-th best example
        least = np.partition(best, len(self.edges) - k, axis=1)[:, len(self.edges) - k] if len(self.edges) >= k else np.zeros(n, np.float32)
        reach = query @ self.most + best + 1e-5 >= least[:, None]
        for i, (a, matrix) in enumerate(zip(self.edges, self.blocks, strict=True)):
            some = np.flatnonzero(reach[:, i])
            part = score[:, a : a + BLOCK]
            if len(some) == n:
                part += query @ matrix
            else:
                part[~reach[:, i]] = -1
                if len(some):
                    part[some] += query[some] @ matrix
        return score

    def nearest(self, queries, k: int, own_ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples of each row; -1 and 0 where there are fewer.  ``queries`` is a
        matrix of unit vectors, or (row, term number, weight) by row, and the number of rows.  ``own_ids``: examples with a
        query's own id are left out."""
        if isinstance(queries, np.ndarray):
            row, number = np.nonzero(queries)
            queries = (row, number, queries[row, number], len(queries))
        row, number, weight, n = queries
        best, who = np.zeros((n, k), np.float32), np.full((n, k), -1, np.int64)
        least = max(len(self.ids) - k, 0)
        for at in range(0, n, QUERIES) if len(self.ids) else ():
            size = min(QUERIES, n - at)
            a, b = np.searchsorted(row, (at, at + size))
            score = self._cosines(row[a:b] - at, number[a:b], weight[a:b], size, k + (self.copies if own_ids is not None else 0))
            if own_ids is not None:
                score[self.ids[None, :] == own_ids[at : at + size, None]] = 0
            kth = np.partition(score, least, axis=1)[:, least]
            r, c = np.nonzero((score >= kth[:, None]) & (score > 0))
            # nearest first; of equal cosines the smaller position
            order = np.lexsort((c, -score[r, c], r))
            r, c = r[order], c[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, rank = r[rank < k], c[rank < k], rank[rank < k]
            best[at + r, rank], who[at + r, rank] = score[r, c], c
        return who, best

    def labels(self, who: np.ndarray) -> np.ndarray:
        """Labels of the examples at these places, -1 for none."""
        return np.where(who >= 0, self.y[np.maximum(who, 0)], -1) if len(self.y) else np.full(who.shape, -1)


class Examples:
    """The sample as counts of terms, with what weights come from: idf, and documents by inner fold and label."""

    def __init__(self, idf: np.ndarray, n0: np.ndarray, n1: np.ndarray, ids: np.ndarray, y: np.ndarray, fold: np.ndarray, numbers: list, counts: list):
        self.idf, self.n0, self.n1 = idf, n0, n1
        self.ids, self.y, self.fold, self.numbers, self.counts = ids, y, fold, numbers, counts

    def index(self, power: float, without: int | None = None) -> BlockMaxIndex:
        """An index of all examples, or of those outside a fold, weighted by these alone."""
        folds = [f for f in range(INNER) if f != without]
        which = np.flatnonzero(self.fold != (-1 if without is None else without))
        p1 = int(self.y[which].sum())
        lean = likelihood_ratio(self.n0[folds].sum(0), self.n1[folds].sum(0), max(len(which) - p1, 1), max(p1, 1))
        return BlockMaxIndex(self.idf, self.idf * (1 + lean) ** power, self.ids[which], self.y[which], [self.numbers[i] for i in which], [self.counts[i] for i in which])

    def nearest_others(self, power: float, fold: int, neighbours: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the examples of a fold; labels and cosines of those outside it that are nearest to each."""
        index, which = self.index(power, fold), np.flatnonzero(self.fold == fold)
        if not len(which):
            return which, np.zeros((0, neighbours)), np.zeros((0, neighbours))
        row = np.repeat(np.arange(len(which)), [len(self.numbers[i]) for i in which])
        number, n = (np.concatenate([v[i] for i in which]) for v in (self.numbers, self.counts))
        who, cosine = index.nearest((row, number, index.unit(row, number, n, len(which)), len(which)), neighbours)
        return which, index.labels(who), cosine


def likelihood_ratio(n0: np.ndarray, n1: np.ndarray, p0: int, p1: int) -> np.ndarray:
    """Of terms' documents by label against the base rate; it holds for rare terms too.  0 if not more frequent with label 1."""
    share = p1 / (p0 + p1)
    part = lambda x, s: x * np.log(np.maximum(x, 1) / np.maximum((n0 + n1) * s, 1e-12))
    return np.where(n1 / p1 > n0 / p0, 2 * (part(n1, share) + part(n0, 1 - share)), 0.0)


class ToxicityModel:
    """``shared`` is the index and its terms, sent to the executors once; ``counts`` has the documents of each term that
    several documents hold, of ``rows`` in all."""

    def __init__(self, terms: np.ndarray, shared, counts: DataFrame, rows: int, power: float, neighbours: int, slack: float, calibrate: Isotonic):
        self.terms, self.shared, self.counts, self.rows = terms, shared, counts, rows
        self.power, self.neighbours, self.slack, self.calibrate = power, neighbours, slack, calibrate


def _validate(batches, shared, choices: list[tuple[int, float]]):
    """Votes on the examples of a fold by the others, for each (power, fold) and each of ``choices`` (by number)."""
    examples = cloudpickle.loads(shared.value)
    for batch in batches:
        for power, fold in zip(*(batch.column(c).to_pylist() for c in ("power", "fold")), strict=True):
            which, label, cosine = examples.nearest_others(power, fold, max(k for k, _ in choices))
            for i, (k, slack) in enumerate(choices):
                vote = votes(label[:, :k], cosine[:, :k], slack)
                yield pa.RecordBatch.from_pydict({"power": pa.array([power] * len(which), pa.float64()), "choice": pa.array([i] * len(which), pa.int32()), "place": pa.array(which, pa.int64()), "vote": pa.array(vote.astype(float))})


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held: int = HELD, powers: tuple[float, ...] = POWERS, neighbours: tuple[int, ...] = NEIGHBOURS, slacks: tuple[float, ...] = SLACKS
) -> ToxicityModel:
    """Indexes at most ``sample`` labelled rows outside the held-out fold, with term counts over all of ``docs``.

    For each power, number of neighbours and slack, and each inner fold of these rows, the others vote on the fold, with
    weights from the others alone; the choice of the smallest mean squared error is taken (the first of those that are equal
    to nine digits), and its votes are what the calibration is fitted to.  No label of a held-out row is read.  Without labelled rows every score is 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(training_sample(docs, labels, "toxic", folds, held, sample), "examples")
    terms = scratch.keep(rows.mapInArrow(_sample_terms, "term long, fold int, n0 long, n1 long").groupBy("term", "fold").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "terms")
    text = docs.select(F.col("text").cast("string").alias("text"))
    counts = text.mapInArrow(_corpus_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where("n > 1")
    counts, total = scratch.keep(counts, "counts"), docs.count()
    # the terms of a bounded sample, here and below
    by = terms.toArrow()
    known, at = np.unique(by.column("term").to_numpy().view(np.uint64), return_inverse=True)
    label = np.zeros((2, INNER, len(known)), np.int64)
    for i in (0, 1):
        label[i, by.column("fold").to_numpy(), at] = by.column(f"n{i}").to_numpy()
    found = counts.join(F.broadcast(terms.select("term").distinct()), "term").toArrow()
    df = np.ones(len(known))
    df[_find(known, found.column("term").to_numpy().view(np.uint64))] = found.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(known)
    out = rows.mapInArrow(lambda bs: _example_counts(bs, shared), "doc_id long, y int, fold int, numbers binary, counts binary").orderBy("doc_id", "y", "numbers").toArrow()
    ids, y, fold = (out.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "y", "fold"))
    numbers, n = ([np.frombuffer(x.as_py(), t) for x in out.column(c)] for c, t in (("numbers", np.int32), ("counts", np.int64)))
    examples = Examples(np.log((1 + total) / (1 + df)) + 1, *label, ids, y, fold, numbers, n)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(examples))
    cells, choices = [(float(p), f) for p in powers for f in range(INNER)], [(int(k), float(x)) for k in neighbours for x in slacks]
    # a vote for each example and choice
    tried = spark.createDataFrame(cells, "power double, fold int").repartition(len(cells), "power", "fold").mapInArrow(lambda bs: _validate(bs, sent, choices), "power double, choice int, place long, vote double").toArrow()
    shared.unpersist()
    sent.unpersist()
    scratch.drop("examples", "terms")
    power, choice, place, vote = (tried.column(c).to_numpy() for c in ("power", "choice", "place", "vote"))
    grid = [(float(p), i) for p in powers for i in range(len(choices))]
    of = [(power == p) & (choice == i) for p, i in grid]
    # the sum of squares in the order of the examples, so that reruns agree
    errors = [round(float(np.mean((vote[w][o] - y[place[w][o]]) ** 2)), 9) if len(ids) else 0.0 for w, o in ((w, np.argsort(place[w])) for w in of)]
    at = int(np.argmin(errors))
    best, (k, slack) = grid[at][0], choices[grid[at][1]]
    calibrate = Isotonic(vote[of[at]], y[place[of[at]]]) if len(ids) else Isotonic(np.zeros(1), np.zeros(1))
    index = spark.sparkContext.broadcast(cloudpickle.dumps((known, examples.index(best))))
    return ToxicityModel(known, index, counts, total, best, k, slack, calibrate)


def _near(batches, shared, neighbours: int):
    """The nearest examples of each text by the terms that examples hold, the sum of squares of these terms, and the terms
    that none holds."""
    known, index = cloudpickle.loads(shared.value)
    for batch in _pieces(batches):
        row, code, n, hashes = counted(batch.column("text"))
        number = _find(known, hashes)[code]
        new = number < 0
        own = np.searchsorted(row[new], np.arange(batch.num_rows + 1)).astype(np.int32)
        others = [pa.ListArray.from_arrays(own, pa.array(v)) for v in (signed(hashes[code[new]]), n[new].astype(np.int64))]
        row, number, n = row[~new], number[~new], n[~new]
        square = np.bincount(row, (np.log1p(n) * index.idf[number]) ** 2, batch.num_rows).astype(float)
        who, cosine = index.nearest((row, number, index.unit(row, number, n, batch.num_rows), batch.num_rows), neighbours)
        offsets = (np.arange(batch.num_rows + 1) * neighbours).astype(np.int32)
        kind = lambda v, t: pa.ListArray.from_arrays(offsets, pa.array(v.ravel(), t))
        there = who >= 0
        ids = np.where(there, index.ids[np.maximum(who, 0)] if len(index.ids) else 0, 0)
        toxic = np.where(there, index.y[np.maximum(who, 0)] if len(index.ids) else 0, -1).astype(np.int32)
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "square": pa.array(square), "ids": kind(ids, pa.int64()), "toxic": kind(toxic, pa.int32()), "cosine": kind(cosine, pa.float32()), "terms": others[0], "n": others[1]}
        )


def votes(toxic: np.ndarray, cosine: np.ndarray, slack: float) -> np.ndarray:
    """Share of label 1 among the neighbours (-1: none), by cosine over distance, with one vote of weight ``slack`` for label
    0.  The slack is added to every distance: the smaller, the more the nearest count."""
    w = np.where(toxic >= 0, cosine / np.maximum(1 + slack - cosine, slack), 0)
    return (w * np.maximum(toxic, 0)).sum(1) / (w.sum(1) + slack)


def _score(batches, calibrate: Isotonic, neighbours: int, slack: float):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
    for batch in batches:
        ids, toxic, cosine = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, neighbours) for c in ("ids", "toxic", "cosine"))
        known, other = batch.column("square").to_numpy(), batch.column("other").to_numpy()
        cosine = cosine * np.sqrt(known / np.maximum(known + other, 1e-12))[:, None]
        first = toxic[:, :3] >= 0
        fields = [pa.array(ids[:, :3][first]), pa.array(toxic[:, :3][first]), pa.array(np.round(cosine[:, :3][first], 6))]
        evidence = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(first.sum(1))].astype(np.int32)), pa.StructArray.from_arrays(fields, ["doc_id", "toxic", "cosine"]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(calibrate(votes(toxic, cosine, slack))), "evidence": evidence.cast(kind)})


def score_toxicity(docs: DataFrame, model: ToxicityModel, folds: int = FOLDS, held: int = HELD, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the three nearest examples and their cosines) for every row.

    A null text is empty; a text that shares no term with an example has no neighbours, and the score of no evidence.
    A term that fewer than two documents of the fit hold weighs as one that one holds.  Repeated rows score alike."""
    scratch, shared = Scratch(docs.sparkSession), model.shared
    calibrate, neighbours, slack = model.calibrate, model.neighbours, model.slack
    rows = with_ids(docs, F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    fields = "doc_id long, h long, square double, ids array<long>, toxic array<int>, cosine array<float>, terms array<long>, n array<long>"
    near = scratch.keep(rows.mapInArrow(lambda bs: _near(bs, shared, neighbours), fields), "near")
    other = near.select("doc_id", "h", F.posexplode(F.arrays_zip("terms", "n")).alias("at", "t")).select("doc_id", "h", (F.col("at") == 0).cast("long").alias("row"), "t.terms", "t.n")
    counts = model.counts.select(F.col("term").alias("terms"), F.col("n").alias("df"))
    weight = F.log1p("n") * (F.log((1 + F.lit(float(model.rows))) / (1 + F.coalesce("df", F.lit(1)))) + 1)
    # repeated rows have one sum
    other = other.join(counts.hint("merge"), "terms", "left").groupBy("doc_id", "h").agg((F.sum(F.round(weight * weight * SQUARE).cast("long")) / (SQUARE * F.sum("row"))).alias("other"))
    near = near.join(other.hint("merge"), ["doc_id", "h"], "left").select("doc_id", "square", "ids", "toxic", "cosine", F.coalesce("other", F.lit(0.0)).alias("other"))
    out = near.mapInArrow(lambda bs: _score(bs, calibrate, neighbours, slack), "doc_id long, score double, evidence array<struct<doc_id: long, toxic: int, cosine: double>>")
    return out.select(id_out(), held_out(id_out(), folds, held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "evidence")
