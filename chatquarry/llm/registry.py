"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op13_byte_bpe
from .chat_format import CHAT_PARTS_SQL, OP4_SQL, chat_parts, op4_chat_format
from .decontaminate import op10_decontaminate
from .jaccard_join import OP6_SQL, op6_jaccard_join
from .language_id import op9_language_id
from .lexical_search import OP11_SQL, op11_lexical_search
from .mixing import op1_mixing
from .pivot_neardup import OP7_SQL, op7_pivot_neardup
from .quality import op8_quality
from .token_alignment import op12_token_alignment
from .toxicity import op3_toxicity
from .url_filter import OP5_SQL, op5_url_filter
from .warc import OP2_SQL, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_warc, op3_toxicity, op4_chat_format, op5_url_filter, op6_jaccard_join, op7_pivot_neardup, op8_quality, op9_language_id, op10_decontaminate, op11_lexical_search, op12_token_alignment, op13_byte_bpe, chat_parts)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op4_chat_format": OP4_SQL, "op5_url_filter": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op7_pivot_neardup": OP7_SQL, "op11_lexical_search": OP11_SQL, "chat_parts": CHAT_PARTS_SQL}
