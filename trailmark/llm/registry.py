"""Queries of this subpackage by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from . import brown_lm, bytebpe, hilbert_pack, itq, jaccard_join, kneser_ney, language_id, license_scan, lloyd, pii, pivot_topk, repair_ids, spelling


def queries() -> dict[str, Callable]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_itq_dedup": itq.op1_itq_dedup,
        "op2_byte_bpe": bytebpe.op2_byte_bpe,
        "op3_language_id": language_id.op3_language_id,
        "op4_kneser_ney": kneser_ney.op4_kneser_ney,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_brown_lm": brown_lm.op7_brown_lm,
        "op8_repair_ids": repair_ids.op8_repair_ids,
        "op9_pivot_topk": pivot_topk.op9_pivot_topk,
        "op10_hilbert_pack": hilbert_pack.op10_hilbert_pack,
        "op11_anagram_variants": spelling.op11_anagram_variants,
        "op12_delta_lloyd": lloyd.op12_delta_lloyd,
        "op13_contextual_pii": pii.op13_contextual_pii,
    }


def oracle_sql() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return whole | {
        "op1_itq_dedup": itq.oracle(),
        "op5_jaccard_join": jaccard_join.oracle(),
        "op6_license_scan": license_scan.oracle(),
        "op9_pivot_topk": pivot_topk.oracle(),
        "op11_anagram_variants": spelling.oracle(),
        "op12_delta_lloyd": lloyd.oracle(),
    }
