"""The queries of this folder and their SQL."""

from __future__ import annotations

from tidemark.llm import ann, chat, collocations, curriculum, decontaminate, jaccard_join, language, licenses, line_dedup, packing, quality, toxicity, whitening

SPARK = {
    "op1_nearest": ann.op1,
    "op2_quality": quality.op2,
    "op3_jaccard_join": jaccard_join.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_line_dedup": line_dedup.op5,
    "op6_packing": packing.op6,
    "op7_language": language.op7,
    "op8_chat_format": chat.op8,
    "op9_licenses": licenses.op9,
    "op10_toxicity": toxicity.op10,
    "op11_whitening": whitening.op11,
    "op12_collocations": collocations.op12,
    "op13_curriculum": curriculum.op13,
}
#: Only these can be said in SQL; the others are held against brute force, held-out labels or exact round trips in tests.
SQL = {
    "op4_decontaminate": decontaminate.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op8_chat_format": chat.SQL,
    "op12_collocations": collocations.SQL,
    "op13_curriculum": curriculum.SQL,
}
