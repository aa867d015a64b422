"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from paraforge.llm import (collocations, language, lines, merkle, mixing, near_dup, neighbours, oracle, search, sentencepiece_scan,
                           site_tree, substrings, token_files, urls)

QUERIES = {
    "op1_main_text": site_tree.op1_main_text,
    "op2_url_filter": urls.op2_url_filter,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_near_duplicates": near_dup.op5_near_duplicates,
    "op6_language_id": language.op6_language_id,
    "op7_sentencepiece": sentencepiece_scan.op7_sentencepiece,
    "op8_search": search.op8_search,
    "op9_token_files": token_files.op9_token_files,
    "op10_near_vectors": neighbours.op10_near_vectors,
    "op11_line_dedup": lines.op11_line_dedup,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": oracle.OP3,
    "op5_near_duplicates": oracle.OP5,
    "op8_search": oracle.OP8,
    "op10_near_vectors": oracle.OP10,
    "op11_line_dedup": oracle.OP11,
    "op12_merkle_manifest": oracle.OP12,
    "op13_collocations": oracle.OP13,
}
