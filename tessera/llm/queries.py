"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.conversation_repair import ORACLE as REPAIR_SQL
from tessera.llm.conversation_repair import op11_conversation_repair
from tessera.llm.decontaminate import op6_decontamination
from tessera.llm.html_text import op10_html_text
from tessera.llm.jaccard_join import op4_jaccard_join
from tessera.llm.license_scan import ORACLE as LICENSE_SQL
from tessera.llm.license_scan import op3_license_scan
from tessera.llm.packing import op2_packing
from tessera.llm.quality import op1_quality
from tessera.llm.spelling_variants import ORACLE as SPELLING_SQL
from tessera.llm.spelling_variants import op12_spelling_variants
from tessera.llm.suffix_tree_lm import op13_suffix_tree_lm
from tessera.llm.token_files import op9_token_files
from tessera.llm.topk_search import ORACLE as TOPK_SQL
from tessera.llm.topk_search import op7_topk_search
from tessera.llm.toxicity import op5_toxicity
from tessera.llm.url_filter import op8_url_filter

QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_license_scan": op3_license_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_topk_search": op7_topk_search,
    "op8_url_filter": op8_url_filter,
    "op9_token_files": op9_token_files,
    "op10_html_text": op10_html_text,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_suffix_tree_lm": op13_suffix_tree_lm,
}

ORACLES: dict[str, str] = {"op3_license_scan": LICENSE_SQL, "op7_topk_search": TOPK_SQL, "op11_conversation_repair": REPAIR_SQL, "op12_spelling_variants": SPELLING_SQL}
