"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_bpe
from .chat_format import OP10_SQL, op10_chat_format
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .html_text import op7_html_text
from .minhash import OP4_SQL, op4_minhash
from .neighbours import OP5_SQL, op5_neighbours
from .packing import op8_packing
from .suffixes import op1_suffix_dedup
from .toxicity import op2_toxicity
from .warc import OP3_SQL, op3_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_warc": op3_warc,
        "op4_minhash": op4_minhash,
        "op5_neighbours": op5_neighbours,
        "op6_bpe": op6_bpe,
        "op7_html_text": op7_html_text,
        "op8_packing": op8_packing,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_chat_format": op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": OP3_SQL,
        "op4_minhash": OP4_SQL,
        "op5_neighbours": OP5_SQL,
        "op9_exact_dedup": OP9_SQL,
        "op10_chat_format": OP10_SQL,
    }
