"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import chat, jaccard, licences, lines, media, packing, passages, quality, secrets, sentencepieces, spellings, token_counts, views

QUERIES = {
    f.__name__: f
    for f in (
        lines.op1_line_dedup,
        sentencepieces.op2_sentencepiece,
        quality.op3_quality_rules,
        media.op4_media,
        passages.op5_substring_dedup,
        token_counts.op6_token_counts,
        jaccard.op7_jaccard_join,
        chat.op8_chat_format,
        licences.op9_licences,
        packing.op10_best_fit_packing,
        views.op11_view_maintenance,
        secrets.op12_secret_scans,
        spellings.op13_spelling_variants,
    )
}

SQL = {"op1_line_dedup": lines.SQL, "op5_substring_dedup": passages.SQL, "op7_jaccard_join": jaccard.SQL, "op8_chat_format": chat.SQL, "op11_view_maintenance": views.SQL, "op12_secret_scans": secrets.SQL}
