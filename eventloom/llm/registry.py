"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe
from .jaccard import op2_jaccard_join
from .language import op5_language_id
from .line_dedup import op8_line_dedup
from .media import op9_media
from .mixing import op7_mixing
from .quality import op10_quality
from .substring_dedup import op1_substring_dedup
from .topk import OP3_SQL, op3_topk
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_jaccard_join, op3_topk, op4_toxicity, op5_language_id, op6_bpe, op7_mixing, op8_line_dedup, op9_media, op10_quality)}
ORACLE_SQL: dict[str, str] = {"op3_topk": OP3_SQL}
