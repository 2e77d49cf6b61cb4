"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .contamination import OP10_SQL, op10_contaminated
from .divergence import OP13_SQL, op13_source_divergence
from .jaccard import op4_near_duplicates
from .mixing import op5_mixed_sources
from .neighbours import op3_nearest
from .periods import op11_periodic_runs
from .secrets import op2_secret_spans
from .sql import OP4_SQL, OP9_SQL
from .separators import op6_token_counts
from .style_tree import op1_main_text
from .substrings import op9_repeats_removed
from .token_files import op8_token_files
from .toxicity import op7_toxicity
from .word_table import op12_word_table

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_secret_spans": op2_secret_spans,
    "op3_nearest": op3_nearest,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_mixed_sources": op5_mixed_sources,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_repeats_removed": op9_repeats_removed,
    "op10_contaminated": op10_contaminated,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_word_table": op12_word_table,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL = {"op4_near_duplicates": OP4_SQL, "op9_repeats_removed": OP9_SQL, "op10_contaminated": OP10_SQL, "op13_source_divergence": OP13_SQL}
