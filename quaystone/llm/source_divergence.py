"""How much the vocabulary of each source of a language diverges from each other source's, in exact integers.

A group's probability of a term depends on the term's count there alone, so a sum over all terms of a language splits
by the supports (the terms with a count) of two groups A and B:

    all terms of A against B's zero + all terms of B against A's zero + (terms - |A| - |B|) both zero
    + for terms of both: (A, B) - (A, 0) - (0, B) + (0, 0)

The one-sided sums come from a histogram of probabilities for each group, priced once against each other group's zero;
the last line from a join of the postings (language, term, source, count) on the term, whose pairs of sources are summed
where they arise; the constant covers all the rest.  No source is ever compared with another over the whole vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch

#: The unit of probabilities, the documents a term needs, the ranks of the terms' part.
UNIT, LEAST_DOCS, RANKS = 1_000_000_000, 3, 200
#: (group, term) pairs that a task holds before it hands them over.
HELD = 2_000_000
#: What ends a term becomes a blank; A-Z become lower case; all other bytes stay.
_TERM_BYTES = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class _Counts:
    """Occurrences and documents of (lang, source, term), summed over a task's texts."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        _, offsets, data = texts.buffers()
        data = pa.py_buffer(data.to_pybytes().translate(_TERM_BYTES) if data else b"")
        plain = pa.StringArray.from_buffers(len(texts), offsets, data, None, 0, texts.offset)
        found = pc.ascii_split_whitespace(plain)
        row = np.repeat(np.arange(len(texts)), np.diff(found.offsets.to_numpy()))
        coded = found.values.dictionary_encode()
        index = coded.indices.to_numpy()
        term = np.array([self.terms.setdefault(t, len(self.terms)) for t in coded.dictionary.to_pylist()], np.int64)
        # by text and term first, so that documents count once
        pair, n = np.unique(row * max(len(term), 1) + index, return_counts=True)
        row, index = np.divmod(pair, max(len(term), 1))
        real = np.ones(len(index), bool) if "" not in self.terms else term[index] != self.terms[""]
        self._sum(group[row[real]], term[index[real]], n[real], np.ones(int(real.sum()), np.int64))
        # the empty term stands for the group itself
        at = np.full(len(group), self.terms.setdefault("", len(self.terms)), np.int64)
        self._sum(group, at, np.zeros(len(group), np.int64), np.ones(len(group), np.int64))

    def _sum(self, group, term, n, d) -> None:
        key, at = np.unique(group << 40 | term, return_inverse=True)
        out = np.zeros((3, len(key)), np.int64)
        out[0] = key
        np.add.at(out[1], at, n)
        np.add.at(out[2], at, d)
        self.parts.append(out)
        self.held += len(key)

    def rows(self):
        """What was summed, and a new start."""
        if not self.parts:
            return
        every = np.concatenate(self.parts, axis=1)
        self.parts = []
        self._sum(every[0] >> 40, every[0] & (2**40 - 1), every[1], every[2])
        key, n, d = self.parts[0]
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        terms, group, term = pa.array(list(self.terms), pa.string()), key >> 40, key & (2**40 - 1)
        for at in range(0, len(key), 50_000):
            part = slice(at, at + 50_000)
            g, t = pa.array(group[part]), pa.array(term[part])
            yield pa.RecordBatch.from_pydict({"lang": langs.take(g), "source": sources.take(g), "term": terms.take(t), "n": pa.array(n[part]), "d": pa.array(d[part])})
        self.__init__()


def _count(batches):
    counts = _Counts()
    for batch in batches:
        counts.add(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"))
        if counts.held > HELD:
            yield from counts.rows()
    yield from counts.rows()


def _share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 1) / total), exact beyond 64 bits."""
    return F.expr(f"1L + (cast({UNIT} as decimal(10, 0)) * cast({n} + 1 as decimal(19, 0))) div cast({total} as decimal(19, 0))")


def _cost(p: str, q: str) -> Column:
    """floor((p - q)^2 / q)."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for every group (lang, source) each other source of the lang (part ``pair``), and
    the ``ranks`` terms that are most frequent against the lang (part ``term``).

    Null lang, source and text are empty; a group whose rows have no terms is a group; a lang without terms in
    ``least_docs`` documents has pairs of value 0.  Repeated rows are documents each.  A term is a run of letters A-Z, which
    become lower case, and characters beyond ASCII.  An empty table has an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = plain.mapInArrow(_count, "lang string, source string, term string, n long, d long")
    # one shuffle by (lang, term) serves the sums by source and those over sources; a task sends a source's term once
    by_term = Window.partitionBy("lang", "term")
    postings = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    postings = postings.select("lang", "term", "source", "n", F.sum("d").over(by_term).alias("docs"), F.sum("n").over(by_term).alias("lang_n"), (F.col("source") == F.min("source").over(by_term)).alias("first"))
    postings = scratch.keep(postings.where((F.col("docs") >= least_docs) | (F.col("term") == "")), "postings")
    real = F.col("term") != ""

    # -- groups: a row for each (lang, source)
    count_if = lambda c: F.count(F.when(c, F.lit(1)))
    groups = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), count_if(real).alias("support"), count_if(real & F.col("first")).alias("firsts"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"))
    groups = groups.join(langs, "lang").withColumn("size", F.col("total") + F.col("terms"))
    zero = F.when(F.col("terms") > 0, F.lit(1).cast("long") + F.expr(f"{UNIT} div size")).otherwise(F.lit(1).cast("long"))
    groups = scratch.keep(groups.select("lang", "source", "terms", "lang_total", "support", "size", zero.alias("zero")), "groups")

    # -- postings with their probabilities
    p, q = _share("n", "size"), _share("lang_n", "lang_total + terms")
    priced = postings.where(real).join(groups, ["lang", "source"]).select("lang", "term", "source", p.alias("p"), q.alias("q"), "zero")
    priced = scratch.keep(priced, "priced")
    scratch.drop("postings")

    # -- part ``pair``
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.col("support").alias("item_support"))
    histogram = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    sides = histogram.join(other, "lang").where("source <> item")
    sides = sides.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _cost("p", "item_zero")).alias("here"), F.sum(F.col("m") * _cost("item_zero", "p")).alias("there"))
    here = sides.select("lang", "source", "item", F.col("here").alias("part_value"))
    there = sides.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("there").alias("part_value"))
    a = priced.select("lang", "term", "source", "p", "zero")
    b = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("q_zero"))
    both = a.join(b.hint("merge"), ["lang", "term"]).where("source < item")
    forth = _cost("p", "q") - _cost("p", "q_zero") - _cost("zero", "q") + _cost("zero", "q_zero")
    back = _cost("q", "p") - _cost("q", "zero") - _cost("q_zero", "p") + _cost("q_zero", "zero")
    both = both.groupBy("lang", "source", "item").agg(F.sum(forth).alias("forth"), F.sum(back).alias("back"))
    both = scratch.keep(both, "both")
    forth = both.select("lang", "source", "item", F.col("forth").alias("part_value"))
    back = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("part_value"))
    constant = groups.join(other, "lang").where("source <> item")
    constant = constant.select("lang", "source", "item", F.when(F.col("terms") > 0, (F.col("terms") - F.col("support") - F.col("item_support")) * _cost("zero", "item_zero")).otherwise(F.lit(0).cast("long")).alias("part_value"))
    pairs = constant.unionByName(here).unionByName(there).unionByName(forth).unionByName(back).groupBy("lang", "source", "item").agg(F.sum("part_value").alias("value"))

    # -- part ``term``: ranks are limited before the shuffle, so a group of any size sends few rows from a task
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), _cost("p", "q").alias("value"))
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return pairs.select(*columns("pair")).unionByName(terms.select(*columns("term")).where(F.col("rank") <= ranks))
