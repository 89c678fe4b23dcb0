"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, fingerprints, language, mixing, neardup, packing, pii, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op10_nearest_neighbours": ann.op10_nearest_neighbours,
        "op1_pack_documents": packing.op1_pack_documents,
        "op2_fingerprint_documents": fingerprints.op2_fingerprint_documents,
        "op3_score_toxicity": toxicity.op3_score_toxicity,
        "op4_remove_repeats": substrings.op4_remove_repeats,
        "op5_replace_entities": pii.op5_replace_entities,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_identify_language": language.op7_identify_language,
        "op8_format_chats": chat.op8_format_chats,
        "op9_near_duplicates": neardup.op9_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mix_sources": mixing.OP6_SQL, "op8_format_chats": chat.OP8_SQL}
