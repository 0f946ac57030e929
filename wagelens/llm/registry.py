"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (chat_format, decontaminate, html_extract, jaccard_join, language_id, line_dedup, lm_score, mixing, periodic_runs,
               permutation_index, phrases, secret_scan, sharding)

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_language_id": language_id.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_permutation_index": permutation_index.op10_permutation_index,
    "op11_phrase_collocations": phrases.op11_phrase_collocations,
    "op12_html_extraction": html_extract.op12_html_extraction,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.OP2_SQL, "op4_mixing": mixing.OP4_SQL,
            "op11_phrase_collocations": phrases.OP11_SQL}
