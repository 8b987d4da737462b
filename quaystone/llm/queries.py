"""Registered queries of the training-data operators, with production parameters on whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.chat_format import CONTROL, END, START, format_chats
from quaystone.llm.common import read
from quaystone.llm.decontamination import contaminated
from quaystone.llm.exact_dedup import exact_duplicates
from quaystone.llm.line_dedup import line_dedup
from quaystone.llm.minhash_forest import near_duplicates
from quaystone.llm.mixing import BLOCK_WORDS, CHUNK, GOLDEN, PERIOD, mix
from quaystone.llm.pieces import encode_pieces
from quaystone.llm.quality import fit_quality, score_quality
from quaystone.llm.secret_scan import scan_secrets
from quaystone.llm.source_divergence import LEAST_DOCS, RANKS, UNIT, source_divergence
from quaystone.llm.substring_dedup import substring_dedup
from quaystone.llm.toxicity import fit_toxicity, score_toxicity
from quaystone.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, codebooks_digest, compress_vectors, with_label_error

#: Fixed value: what both turns of conversation -1 say.
PROBE = "</s>[INST] ok [/INST]"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"), keep="max")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"), window=50)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=75)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return format_chats(turns.unionByName(probe))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the compressed bitmap is the operator's; the query shows what its bits are
    return line_dedup(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1).drop("keep_bitmap")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress_vectors(read(spark, sf_dir, "embeddings"))
    out = with_label_error(codes)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = """SELECT DISTINCT {id}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
    FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM (SELECT {id}, {words} AS w FROM {table}) WHERE len(w) > 0)"""


def _shingles(table: str, key: str) -> str:
    return _SHINGLES.format(id=key, table=table, words=_WORDS.format(_LOWER.format("text")))


def _chat_sql() -> str:
    literal = lambda x: "'" + x.replace("'", "''") + "'"
    escape = lambda x: "".join("\\" + c if c in r"\.[]()|^$*+?{}" else c for c in x)
    conflict = "|".join(f"{escape(c[0])}\\\\*{escape(c[1:])}" for c in CONTROL)
    return f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', {literal(PROBE)} UNION ALL SELECT -1, 1, 'assistant', {literal(PROBE)}
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    CAST(sum({len(START)} + length(role) + 1 + length(text) + len(regexp_extract_all(text, {literal(conflict)})) + {len(END)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def _secrets_sql() -> str:
    """Starts of matches are sums of the pieces between them and the matches before."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"
    assign = rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    patterns = {"assign": (assign, 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24), "pem": ("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1)}
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(patterns.items()):
        q = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, unnest(regexp_extract_all(t, {q})) AS m, unnest(regexp_extract_all(t, {q}, {group})) AS g, "
            f"unnest(list_slice(regexp_split_to_array(t, {q}), 1, len(regexp_extract_all(t, {q})))) AS p, generate_subscripts(regexp_extract_all(t, {q}), 1) AS i FROM d"
        )
    union = " UNION ALL ".join(parts)
    count = lambda kind: f"CAST(count(*) FILTER (kind = '{kind}') AS BIGINT) AS n_{kind}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ({union}),
s AS (SELECT doc_id, kind, rank, least, g, m, sum(length(p)) OVER w + sum(length(m)) OVER w AS e FROM x WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
f AS (SELECT doc_id, kind, rank, CAST(e - length(m) AS BIGINT) AS b, kind || ':' || CAST(e - length(m) AS BIGINT) || ':' || CAST(e AS BIGINT) AS shown FROM s WHERE length(g) >= least),
a AS (SELECT doc_id, {count('assign')}, {count('access')}, {count('hex')}, string_agg(shown, ',' ORDER BY b, rank) FILTER (kind <> 'pem') AS base, string_agg(shown, ',' ORDER BY b, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


def _mixing_sql() -> str:
    """A source's stream is taken whole for so many epochs, then from its start: the words of a document are those
    epochs of its size and what of it lies before the rest.  Its first slot is that of the blocks it lies in."""
    digit = lambda i: f"(strpos('0123456789abcdef', substr(place, {i}, 1)) - 1) * {16 ** (6 - i)}"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format('text')}) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR) || ':7:' || md5(coalesce(text, ''))) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
w AS (SELECT *, CAST((k - 1) % 3 + 1 AS DOUBLE) AS w FROM r),
g AS (SELECT *, cap / w AS filled, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
    FROM w WINDOW b AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, coalesce((SELECT level FROM g WHERE level <= filled ORDER BY filled, k LIMIT 1), CAST('inf' AS DOUBLE)) * w) AS target FROM g),
q AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) AS quota, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS epochs, quota - epochs * source_size AS rest FROM t),
p AS (SELECT d.*, k, source_size, target, epochs, rest, ({' + '.join(digit(i) for i in range(1, 7))}) % greatest(n // {CHUNK}, 1) AS chunk FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY chunk, place, doc_id ROWS UNBOUNDED PRECEDING) AS upto, upto - size AS begin FROM p),
b AS (SELECT CAST({BLOCK_WORDS} AS BIGINT) AS bw),
c AS (SELECT k, rest, bw, (source_size + bw - 1) // bw AS blocks, epochs * blocks + (rest + bw - 1) // bw AS need FROM q, b),
z AS (SELECT *, sum(need) OVER (ORDER BY k) AS hi, hi - need AS lo, sum(need) OVER () AS slots FROM c),
u AS (SELECT slot, CAST(((slot % {PERIOD}) * {GOLDEN}) % {PERIOD} AS DOUBLE) / {PERIOD} AS u FROM (SELECT unnest(range(CAST(max(slots) AS BIGINT))) AS slot FROM z)),
h AS (SELECT slot, k, need, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS turn FROM u JOIN z ON u >= CAST(lo AS DOUBLE) / slots AND u < CAST(hi AS DOUBLE) / slots),
m AS (SELECT k, need, slots, n, sum(need - n) OVER (ORDER BY k) - need AS behind FROM (SELECT z.k, z.need, slots, count(h.slot) AS n FROM z LEFT JOIN h ON h.k = z.k GROUP BY ALL) WHERE need > n),
v AS (SELECT slot, k, turn FROM h WHERE turn < need UNION ALL SELECT CAST(slots + behind + turn AS BIGINT), k, turn FROM (SELECT k, slots, behind, unnest(range(n, CAST(need AS BIGINT))) AS turn FROM m)),
x AS (SELECT k, turn % blocks AS block, bw, min(slot) FILTER (NOT (turn = need - 1 AND rest > 0)) AS whole, min(slot) FILTER (turn = need - 1 AND rest > 0) AS last, any_value((rest - 1) % bw + 1) AS part FROM v JOIN c USING (k) GROUP BY ALL),
y AS (SELECT doc_id, k, begin, unnest(range(CAST(begin // bw AS BIGINT), CAST((begin + size - 1) // bw + 1 AS BIGINT))) AS block FROM e, b WHERE size > 0),
f AS (SELECT doc_id, min(least(whole, CASE WHEN part > greatest(begin, block * bw) - block * bw THEN last END)) AS first_slot FROM y JOIN x USING (k, block) GROUP BY doc_id)
SELECT e.doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(upto, rest) - begin) AS BIGINT) AS taken, first_slot FROM e LEFT JOIN f ON f.doc_id = e.doc_id"""


def _codes_sql() -> str:
    """Every round compares every part with every entry of its codebook; the smallest of distance * 256 + index is the
    nearest entry, of equal ones the first."""
    dot = lambda a, b: f"CAST(list_inner_product({a}, {b}) AS BIGINT)"
    near = f"min(({dot('p.v', 'p.v')} - 2 * {dot('p.v', 'c.v')} + {dot('c.v', 'c.v')}) * 256 + c.k)"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT p.row, p.part, {near} AS best FROM p JOIN c{r} c ON c.part = p.part GROUP BY ALL)")
        if r < ROUNDS:
            steps.append(
                f"s{r} AS (SELECT part, k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.part, best % 256 AS k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r} a JOIN p ON p.row = a.row AND p.part = a.part) GROUP BY ALL), "
                f"m{r} AS (SELECT part, k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS v FROM s{r} GROUP BY ALL), "
                f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.k = c.k)"
            )
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM e, range({PARTS}) t(part)),
c0 AS MATERIALIZED (SELECT part, row - 1 AS k, v FROM p WHERE row <= {ENTRIES}),
{', '.join(steps)},
g AS (SELECT row, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row),
h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, k, j)) AS books FROM (SELECT part, k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM c{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256 FROM e JOIN g ON g.row = e.row, h"""


def _divergence_sql() -> str:
    """The sums over all terms of a lang for each pair of its sources, term by term."""
    share = lambda n, t: f"(1 + CAST({UNIT} AS HUGEINT) * ({n} + 1) // ({t}))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT doc, lang, source, {_LOWER.format("unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))")} AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 't.total + l.v')} AS p, {share('k.n', 'l.total + l.v')} AS q
    FROM t JOIN l ON l.lang = t.lang JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
o AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
        LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.item = h.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
QUALIFY part = 'pair' OR rank <= {RANKS}"""


ORACLES = {
    "op2_secret_scan": _secrets_sql(),
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op4_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, len(coalesce(ps, [])) AS r,
    CASE WHEN ps IS NULL THEN w ELSE list_filter(list_transform(range(1, len(w) + 1), lambda j: CASE WHEN list_contains(ps, j) THEN NULL ELSE w[j] END), lambda x: x IS NOT NULL) END AS kept
    FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op5_decontamination": f"""
WITH bw AS (SELECT item_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark), dw AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
ks AS (SELECT DISTINCT len(w) AS k FROM bw WHERE len(w) BETWEEN 1 AND 4),
ds AS ({_shingles('documents', 'doc_id')} UNION SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
bs AS ({_shingles('benchmark', 'item_id')}),
size AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, hit.item_id, c AS common, n AS item_shingles, c / n AS containment FROM hit JOIN size ON size.item_id = hit.item_id WHERE 100 * c >= 75 * n""",
    "op6_minhash_near_dedup": f"""
WITH RECURSIVE s AS MATERIALIZED ({_shingles('documents', 'doc_id')}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id""",
    "op7_chat_format": _chat_sql(),
    "op8_source_mixing": _mixing_sql(),
    "op12_vector_codes": _codes_sql(),
    "op13_source_divergence": _divergence_sql(),
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
c AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN c.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256,
    sha256(string_agg(CASE WHEN c.k IS NULL THEN '1' ELSE '0' END, '' ORDER BY i)) AS keep_sha256
FROM l LEFT JOIN c ON c.k = l.k GROUP BY doc_id""",
}
