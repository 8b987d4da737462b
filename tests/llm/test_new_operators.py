"""SentencePiece encoding, vector codes and source divergence against brute force and the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quaystone.llm.pieces import Segmenter, encode_pieces, split
from quaystone.llm.queries import op11_sentencepiece, op12_vector_codes
from quaystone.llm.source_divergence import source_divergence
from quaystone.llm.vector_codes import compress_vectors, decode_vectors, moved_entries, reassign, scan, squares, with_label_error

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, own string, h string, number int"
TEXTS = [None, "", " ", "  ", "a ", " a", "a  b   c", "▁", "x▁▁y ▁", "one\ntwo\n three \n", "\x00 \x01", "é ﬁ ½ 你好 \U0001f600", "<s> </s> <unk>", "w " * 3000, "q" * 5000, "same words here", "same words here"]


@pytest.fixture(scope="module")
def library():
    with open(MODEL, "rb") as f:
        return Segmenter(f.read()).library


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], SCHEMA).repartition(3)


# -- SentencePiece


@pytest.mark.parametrize(("sample", "most"), [(20_000, 2**19), (1, 5), (20_000, 0)])
def test_pieces_equal_the_library(spark, library, sample, most):
    """Whatever is in the table of frequent chunks: all, few, or none."""
    r = random.Random(1)
    rows = [*enumerate(TEXTS), (None, "no id"), (None, "no id"), (3, "another text of one id")]
    rows += [(100 + i, "".join(r.choice(["tax", " ", " ", "\n", "naïve", "▁", "0", "ing"]) for _ in range(r.randrange(40)))) for i in range(40)]
    got = encode_pieces(texts(spark, rows), MODEL, sample, most).collect()
    expected = [(i, [*library.encode(t or ""), library.eos_id()]) for i, t in rows]
    key = lambda x: (x[0] is None, x[0], x[1])
    assert sorted(((g["doc_id"], g["ids"]) for g in got), key=key) == sorted(expected, key=key)
    assert all(g["decoded"] == library.decode(g["ids"]) for g in got)


def test_pieces_of_no_texts(spark):
    assert encode_pieces(texts(spark, []), MODEL).collect() == []


def test_pieces_query(spark, library):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {}
    for i, text in rows.items():
        ids = library.encode(text, add_eos=True)
        expected[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op11_sentencepiece(spark, SF).collect()}
    assert got == expected


def test_chunks_are_the_text():
    for t in filter(None, TEXTS):
        assert "".join(" " + c for c in split(t, True)) == " " + t.replace("▁", " ")
        assert split(t, False) == [t]


def test_a_task_segments_a_chunk_once(library, monkeypatch):
    """Chunks of the shared table never, each other one when it is first met, and anew once the task's table was full."""
    from quaystone.llm import pieces

    with open(MODEL, "rb") as f:
        segmenter = Segmenter(f.read())
    seen, plain = [], segmenter.segment
    segmenter.segment = lambda found: seen.extend(found) or plain(found)
    shared = {"the": 0}, np.array(library.encode("the"), np.int32), np.zeros(1, np.int64), np.array([len(library.encode("the"))])
    tables = pieces._Tables(shared, segmenter)
    for _ in range(3):
        (numbers,) = tables.numbers([split("the rare the words rare", True)])
        assert tables.ids(numbers).tolist() == library.encode("the rare the words rare")
    assert seen == ["rare", "words"]
    monkeypatch.setattr(pieces, "OWN", 1)
    (numbers,) = tables.numbers([["rare", "words", ""]])
    assert seen[2:] == ["rare", "words", ""] and tables.ids(numbers).tolist() == library.encode("rare words ")


# -- vector codes


def lloyd(rows, parts, entries, rounds):
    """(vec_id, code, error) by comparing every part with every entry, in Python's integers, and the codebooks."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0], x[1]))
    width = -(-max((len(v) for _, v in kept), default=0) // parts)
    ints = [[int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (parts * width - len(v)) for _, v in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda k: (distance(x, book[k]), k))
    for _ in range(rounds):
        of = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                members = [c[p] for c, a in zip(cut, of, strict=True) if a[p] == k]
                if members:
                    books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = []
    for (i, _), c in zip(kept, cut, strict=True):
        code = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, bytes(code), sum(distance(c[p], books[p][code[p]]) for p in range(parts))))
    return out, books


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "d", "e") for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, entry string, _salt string").repartition(3)


def some_vectors(n=90, seed=3):
    r = np.random.RandomState(seed)
    rows = [(int(i), [float(x) for x in np.float32(r.randint(-3, 4, 8) / r.choice([1, 512, 1000]))], [None, 0, 1][i % 3]) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0, None] * 4, 1), (n + 2, [float("nan")] * 8, 2), (n + 3, [float("inf")] + [0.0] * 7, 2)]
    return [*rows, rows[5], rows[5], (5, [0.5] * 8, 0), (None, [0.25] * 8, None), (7, [1.0] * 6, 0), (8, [], 1)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 16, 4), (2, 256, 3), (3, 1, 2), (4, 7, 0)])
def test_codes_equal_lloyds(spark, parts, entries, rounds):
    rows = some_vectors()
    codes, books = compress_vectors(vectors(spark, rows), parts, entries, rounds)
    expected, own = lloyd([r[:2] for r in rows], parts, entries, rounds)
    key = lambda x: (x[0] is None, x[0], x[1:])
    assert books.tolist() == own
    assert sorted(((r["vec_id"], bytes(r["code"]), r["error"]) for r in codes.collect()), key=key) == sorted(expected, key=key)


def test_label_errors(spark):
    codes, _ = compress_vectors(vectors(spark, some_vectors()), entries=8)
    rows, total = with_label_error(codes).collect(), {}
    for r in rows:
        total[r["label"]] = total.get(r["label"], 0) + r["error"]
    assert len(rows) == codes.count() and None in total
    assert all(r["label_error"] == total[r["label"]] for r in rows)


def test_codes_of_no_vectors(spark):
    codes, books = compress_vectors(vectors(spark, [(1, None, 1)]))
    assert codes.collect() == [] and books.size == 0 and with_label_error(codes).collect() == []


def test_components_out_of_range(spark):
    with pytest.raises(Exception, match="exact"):
        compress_vectors(vectors(spark, [(1, [1e9] * 4, 1)]))


def test_bounds_spare_scans_and_keep_ties():
    """Round by round the bounded assignment is the full one; later rounds compare few parts with all entries."""
    r = np.random.RandomState(0)
    centres = r.randint(-4000, 4000, (20, 6))
    x = (centres[r.randint(0, 20, 3000)] + r.randint(-3, 4, (3000, 6))).astype(np.int64)
    x[:300] = x[300:600]
    books = np.concatenate([x[:30], x[:2]])[None]
    entry, upper, lower = scan(x, books[0])
    scanned = []
    for _ in range(6):
        sums = {int(k): (int((entry == k).sum()), x[entry == k].sum(0).tolist()) for k in np.unique(entry)}
        books, moved = moved_entries(books, sums)
        entry, upper, lower, n = reassign(x, books[0], entry, upper, lower, moved[0])
        assert (entry == squares(x, books[0]).argmin(1)).all()
        assert (upper**2 >= squares(x, books[0])[np.arange(len(x)), entry]).all()
        scanned.append(n)
    assert scanned[-1] < len(x) / 2


def test_distances_beyond_floats():
    x, book = np.array([[2**26, -(2**26) + 1]], np.int64), np.array([[-(2**26), 2**26 - 1], [0, 1]], np.int64)
    assert squares(x, book).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x[0], c, strict=True)) for c in book]]


def test_decoded_vectors(spark):
    rows = [(i, [i / 4, 1.0, -0.5, 2.0], 0) for i in range(5)]
    codes, books = compress_vectors(vectors(spark, rows), 2, 256, 2)
    assert sorted((r["vec_id"], r["embedding"]) for r in decode_vectors(codes, books).collect()) == [r[:2] for r in rows]


def test_codes_query_has_no_row_twice(spark):
    out = op12_vector_codes(spark, SF).agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("d"), F.countDistinct("codebooks_sha256").alias("c")).first()
    assert out["n"] == out["d"] and out["c"] == 1


# -- divergence


def divergence(rows, least, ranks):
    docs, groups = {}, {}
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        groups.setdefault((lang, source), {})
        run, terms = "", []
        for c in text + " ":
            if ord(c) >= 128 or c.isalpha():
                run += c.lower() if ord(c) < 128 else c
            elif run:
                terms.append(run)
                run = ""
        for t in terms:
            groups[lang, source][t] = groups[lang, source].get(t, 0) + 1
        for t in set(terms):
            docs[lang, t] = docs.get((lang, t), 0) + 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (a, t), n in docs.items() if a == lang and n >= least]
        sources = [s for a, s in groups if a == lang]
        count = {s: {t: groups[lang, s].get(t, 0) for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p(count[s], t), p(count[o], t)) for t in kept), o) for o in sources if o != s]
            terms = [(-f(p(count[s], t), p(whole, t)), t) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:ranks])):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def sources(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 3) for r in rows], "lang string, source string, text string, rank int, value string, p long").repartition(3)


@pytest.mark.parametrize(("least", "ranks"), [(3, 200), (1, 2), (50, 200)])
def test_divergence(spark, least, ranks):
    r = random.Random(2)
    words = ["Ärger", "ärger", "tax", "TAX", "x2y", "naïve", "é", "K", "long"]  # the Kelvin sign is no letter K
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None]), " ".join(r.choice(words) + r.choice(["", ",", "1"]) for _ in range(r.choice([0, 1, 5, 40])))) for _ in range(120)]
    rows += [("en", "a", None), ("en", "void", "12 34"), ("fr", "alone", "une"), rows[0], rows[0], ("en", "long", "word " * 20_000)]
    got = sorted(tuple(x) for x in source_divergence(sources(spark, rows), least, ranks).collect())
    assert got == divergence(rows, least, ranks)


def test_divergence_of_no_documents(spark):
    assert source_divergence(sources(spark, [])).collect() == []


def test_divergence_pairs_stay_in_a_language(spark):
    out = source_divergence(spark.read.parquet(f"{SF}/documents.parquet")).where("part = 'pair'")
    groups = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source").distinct().groupBy("lang").count()
    assert out.count() == sum(r["count"] * (r["count"] - 1) for r in groups.collect())
