"""Queries of this package over the given tables, and their DuckDB text where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from skarn.llm.byte_bpe import op13_byte_bpe
from skarn.llm.chat import op10_chat_formatting
from skarn.llm.decontamination import op3_benchmark_decontamination
from skarn.llm.html_text import op1_html_extraction
from skarn.llm.lexical import ORACLE_SQL as SEARCH_SQL, op11_ranked_search
from skarn.llm.line_dedup import op2_line_dedup
from skarn.llm.packing import op5_best_fit_packing
from skarn.llm.periodic import op12_periodic_runs
from skarn.llm.quality import op8_quality_rules
from skarn.llm.secrets import op4_secret_scans
from skarn.llm.simhash import op7_simhash_near_dedup
from skarn.llm.token_files import op9_token_files
from skarn.llm.url_filter import op6_url_filters

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_line_dedup": op2_line_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_secret_scans": op4_secret_scans,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_url_filters": op6_url_filters,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_files": op9_token_files,
    "pipeline": corpus_pipeline.run,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_ranked_search": op11_ranked_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES: dict[str, str] = {"op11_ranked_search": SEARCH_SQL}
