"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quaystone.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


FIRST = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op4_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_decontamination": ["doc_id", "item_id"],
    "op6_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op7_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op8_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op10_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op11_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op13_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "pipeline": ["doc_id", "size", "source_size", "target", "taken"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    """The contract's columns come first, and SQL, where there is any, has the same rows."""
    out = QUERIES[name](spark, SF)
    assert out.columns[: len(FIRST[name])] == FIRST[name]
    columns = sorted(out.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = sorted(tuple(map(plain, r)) for r in out.select(columns).collect())
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        expected = con.sql(ORACLES[name])
        assert set(columns) == set(expected.columns)
        assert rows == sorted(tuple(map(plain, r)) for r in expected.select(", ".join(columns)).fetchall())
