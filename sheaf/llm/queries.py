"""Catalogue of this subpackage: query name -> function(spark, sf_dir), and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat_formatting
from .codes import OP13_SQL, op13_vector_codes
from .decontam import op4_decontamination
from .langid import op1_language_id
from .licenses import op6_license_scans
from .lm import op8_lm_scoring
from .neardup import OP10_SQL, op10_minhash_neardup
from .packing import op5_best_fit_packing
from .quality import op7_quality_rules
from .ranges import OP12_SQL, op12_embedding_neardup
from .secrets import op3_secret_scans
from .spelling import op11_spelling_variants
from .urls import op2_url_filters


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_url_filters": op2_url_filters,
        "op3_secret_scans": op3_secret_scans,
        "op4_decontamination": op4_decontamination,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_license_scans": op6_license_scans,
        "op7_quality_rules": op7_quality_rules,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_minhash_neardup": op10_minhash_neardup,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_embedding_neardup": op12_embedding_neardup,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_chat_formatting": OP9_SQL,
        "op10_minhash_neardup": OP10_SQL,
        "op12_embedding_neardup": OP12_SQL,
        "op13_vector_codes": OP13_SQL,
    }
