"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from harvestry.llm import alignment, audit, fingerprints, langid, licenses, lines, packing, pieces, scoring, simhash, toxicity, transport, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_simhash": simhash.op3_simhash,
        "op4_transport_stream": transport.op4_transport_stream,
        "op5_lm_scoring": scoring.op5_lm_scoring,
        "op6_packing": packing.op6_packing,
        "op7_embedding_dedup": vectors.op7_embedding_dedup,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_language_id": langid.op9_language_id,
        "op10_line_dedup": lines.op10_line_dedup,
        "op11_fingerprints": fingerprints.op11_fingerprints,
        "op12_filter_audit": audit.op12_filter_audit,
        "op13_token_alignment": alignment.op13_token_alignment,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": lines.OP10_SQL, "op12_filter_audit": audit.OP12_SQL}
