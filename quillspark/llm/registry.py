"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .decontaminate import OP5_SQL, op5_decontaminate
from .html_extract import op10_html_extract
from .langid import op2_language_id
from .matroska import op6_matroska
from .mixing import OP9_SQL, op9_mix
from .periodic import op11_periodic_runs
from .pieces import op13_sentencepiece
from .pii import op7_pii
from .prefixes import OP12_SQL, op12_prefix_trie
from .quality import op8_quality
from .repeats import op1_substring_dedup
from .simhash import op3_simhash
from .tokens import op4_token_files

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_decontaminate": op5_decontaminate,
    "op6_matroska": op6_matroska,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_mix": op9_mix,
    "op10_html_extract": op10_html_extract,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_sentencepiece": op13_sentencepiece,
}

SQL: dict[str, str] = {
    "op5_decontaminate": OP5_SQL,
    "op9_mix": OP9_SQL,
    "op12_prefix_trie": OP12_SQL,
}
