"""The queries of this subpackage by name."""

from __future__ import annotations

from marlstone.llm import bpe, conversations, decontaminate, html_main, jaccard, lines, lm, merkle, packed_ids, quality, secrets, substrings, warc

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.query,
    "op2_bpe_round_trip": bpe.query,
    "op3_quality_rules": quality.query,
    "op4_lm_scores": lm.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_packed_ids": packed_ids.query,
    "op7_substring_dedup": substrings.query,
    "op8_warc": warc.query,
    "op9_secret_scans": secrets.query,
    "op10_html_main": html_main.query,
    "op11_conversation_repair": conversations.query,
    "op12_line_dedup": lines.query,
    "op13_merkle_manifest": merkle.query,
}

#: The others can't be said in SQL over whole tables in sensible time; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op4_lm_scores": lm.SQL, "op12_line_dedup": lines.SQL}
