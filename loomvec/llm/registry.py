"""Queries of the training-data operators, by name, and SQL for those that SQL can express.

Trained models, tokenizers, XXH64 and seeded draws have no SQL; those operators are tested against brute force.
"""

from loomvec.llm import chat, cross_polytope, debruijn, divergence, filter_audit, language_id, mixing, packing, sharding, simhash, token_counts, toxicity, winnowing

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_mixing": mixing.query,
    "op3_language_id": language_id.query,
    "op4_simhash": simhash.query,
    "op5_winnowing": winnowing.query,
    "op6_sharding": sharding.query,
    "op7_packing": packing.query,
    "op8_token_counts": token_counts.query,
    "op9_chat": chat.query,
    "op10_cross_polytope": cross_polytope.query,
    "op11_divergence": divergence.query,
    "op12_debruijn": debruijn.query,
    "op13_filter_audit": filter_audit.query,
}

_ESCAPED = r"length(replace(replace({0}, '\', '\\'), '<|', '<\|'))"

ORACLE_SQL: dict[str, str] = {
    "op11_divergence": divergence.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
    "op9_chat": rf"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{chat.PROBE_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{chat.PROBE_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.START) + len(chat.END) + 2} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
}
