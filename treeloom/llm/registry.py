"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm.alignment import op13_alignment
from treeloom.llm.ann import OP1_SQL, op1_ann
from treeloom.llm.audio_prints import op2_audio_prints
from treeloom.llm.edit_counts import op8_edit_counts
from treeloom.llm.html_text import op10_html_text
from treeloom.llm.langid import op4_language_id
from treeloom.llm.metric_search import OP12_SQL, op12_exact_topk
from treeloom.llm.mixing import op6_mixing
from treeloom.llm.near_dedup import op5_near_dedup
from treeloom.llm.packing import op9_packing
from treeloom.llm.quality import op7_quality
from treeloom.llm.sharding import OP3_SQL, op3_sharding
from treeloom.llm.turn_repair import op11_turn_repair


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": op1_ann,
        "op2_audio_prints": op2_audio_prints,
        "op3_sharding": op3_sharding,
        "op4_language_id": op4_language_id,
        "op5_near_dedup": op5_near_dedup,
        "op6_mixing": op6_mixing,
        "op7_quality": op7_quality,
        "op8_edit_counts": op8_edit_counts,
        "op9_packing": op9_packing,
        "op10_html_text": op10_html_text,
        "op11_turn_repair": op11_turn_repair,
        "op12_exact_topk": op12_exact_topk,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ann": OP1_SQL, "op3_sharding": OP3_SQL, "op12_exact_topk": OP12_SQL}
