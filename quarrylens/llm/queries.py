"""Registered queries of the training-data operators."""

from quarrylens.llm.conversations import op12_conversations
from quarrylens.llm.decontaminate import op3_decontamination
from quarrylens.llm.embedding_dedup import op5_embeddings
from quarrylens.llm.html_text import op2_html
from quarrylens.llm.jaccard import op7_jaccard
from quarrylens.llm.langid import op1_language
from quarrylens.llm.licenses import op9_licenses
from quarrylens.llm.line_dedup import OP11_SQL, op11_lines
from quarrylens.llm.packing import op8_packing
from quarrylens.llm.pii import op4_pii
from quarrylens.llm.quality import op6_quality
from quarrylens.llm.spelling import OP13_SQL, op13_spelling
from quarrylens.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_language_string_kernel": op1_language,
    "op2_html_layout_text": op2_html,
    "op3_decontamination_simhash": op3_decontamination,
    "op4_pii_boosted_candidates": op4_pii,
    "op5_embedding_sorted_projections": op5_embeddings,
    "op6_quality_cotraining": op6_quality,
    "op7_jaccard_signature_trees": op7_jaccard,
    "op8_best_fit_packing": op8_packing,
    "op9_license_tfidf_inheritance": op9_licenses,
    "op10_toxicity_crf": op10_toxicity,
    "op11_line_keep_bitmaps": op11_lines,
    "op12_conversation_repair_fst": op12_conversations,
    "op13_spelling_wildcard_groups": op13_spelling,
}
ORACLE_SQL: dict[str, str] = {"op11_line_keep_bitmaps": OP11_SQL, "op13_spelling_wildcard_groups": OP13_SQL}
