"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_bpe
from .conversations import OP11_SQL, op11_conversation_trie
from .decontamination import OP13_SQL, op13_decontamination
from .embeddings import op2_embeddings
from .filter_audit import OP12_SQL, op12_filter_audit
from .line_dedup import op4_line_dedup
from .packing import op6_packing
from .pii import op5_pii
from .sharding import op9_sharding
from .simhash import op3_simhash
from .sketch import op7_fingerprints
from .token_files import op10_token_files
from .toxicity import op1_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_embeddings": op2_embeddings,
        "op3_simhash": op3_simhash,
        "op4_line_dedup": op4_line_dedup,
        "op5_pii": op5_pii,
        "op6_packing": op6_packing,
        "op7_fingerprints": op7_fingerprints,
        "op8_bpe": op8_bpe,
        "op9_sharding": op9_sharding,
        "op10_token_files": op10_token_files,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_filter_audit": op12_filter_audit,
        "op13_decontamination": op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    """Of the last three. The first ten aren't expressible in SQL on whole tables; tests/llm holds them against brute force."""
    return {"op11_conversation_trie": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_decontamination": OP13_SQL}
