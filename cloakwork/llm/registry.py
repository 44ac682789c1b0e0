"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import conversations, decontaminate, dedup, langid, licenses, lines, neardup, packing, paragraphs, phrases, secrets, toxicity, urls

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_exact_dedup": dedup.op2_exact_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_language_id": langid.op4_language_id,
    "op5_url_filter": urls.op5_url_filter,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_substring_dedup": paragraphs.op7_substring_dedup,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_ngram_jaccard": neardup.op10_ngram_jaccard,
    "op11_collocations": phrases.op11_collocations,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLES = {
    "op2_exact_dedup": dedup.OP2_SQL,
    "op5_url_filter": urls.OP5_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op10_ngram_jaccard": neardup.OP10_SQL,
    "op11_collocations": phrases.OP11_SQL,
}
