"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexa.llm.byte_bpe import op10_byte_bpe
from codexa.llm.html_extract import OP9_SQL, op9_html
from codexa.llm.language_id import op4_language_id
from codexa.llm.line_dedup import OP8_SQL, op8_line_dedup
from codexa.llm.media import op7_media
from codexa.llm.mixing import OP1_SQL, op1_mix_sources
from codexa.llm.pii import op5_pii
from codexa.llm.quality_rules import op2_quality_rules
from codexa.llm.simhash_dedup import op6_simhash
from codexa.llm.suffix_dedup import op3_suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_quality_rules": op2_quality_rules,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_language_id": op4_language_id,
        "op5_pii": op5_pii,
        "op6_simhash": op6_simhash,
        "op7_media": op7_media,
        "op8_line_dedup": op8_line_dedup,
        "op9_html": op9_html,
        "op10_byte_bpe": op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op8_line_dedup": OP8_SQL, "op9_html": OP9_SQL}
