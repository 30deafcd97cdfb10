"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, mixing, url_filters
from .exact_dedup import op7_exact_dedup
from .html_blocks import op5_html_extraction
from .line_quality import op4_line_quality
from .mixing import op8_mixing
from .mpeg_audio import op10_mpeg_audio
from .packing import op3_harmonic_packing
from .repeated_spans import op2_substring_dedup
from .simhash import op6_simhash_near_dedup
from .toxicity import op1_toxicity
from .url_filters import op9_url_filters

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_harmonic_packing": op3_harmonic_packing,
    "op4_line_quality": op4_line_quality,
    "op5_html_extraction": op5_html_extraction,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_url_filters": op9_url_filters,
    "op10_mpeg_audio": op10_mpeg_audio,
}

ORACLES: dict[str, str] = {
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_url_filters": url_filters.OP9_SQL,
}
