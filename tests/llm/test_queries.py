"""The registered queries: contract columns, and the SQL of those that have one."""

import pytest

import __spark_entry__ as entry
from tests.oracle_harness import compare

COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_url_filters": {"page_id", "host", "path", "rule", "verdict"},
    "op3_secret_scans": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op4_decontamination": {"doc_id", "item_id"},
    "op5_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op6_license_scans": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op7_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op8_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op9_chat_formatting": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op10_minhash_neardup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op11_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    "op12_embedding_neardup": {"vec_id", "n_links", "component_id", "kept"},
    "op13_vector_codes": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
}
SOURCES = {"op2_url_filters": "pages", "op9_chat_formatting": "conversations", "op12_embedding_neardup": "embeddings",
           "op13_vector_codes": "embeddings"}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, sf_small, name):
    if name in entry.oracle_sql():
        assert compare(spark, sf_small, [name], verbose=False)[name].startswith("ok")
    df = entry.queries()[name](spark, sf_small)
    assert COLUMNS[name] <= set(df.columns)
    if name not in ("op4_decontamination", "op5_best_fit_packing", "op9_chat_formatting", "op11_spelling_variants"):
        assert df.count() == spark.read.parquet(f"{sf_small}/{SOURCES.get(name, 'documents')}.parquet").count()
