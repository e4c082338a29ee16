"""Schemas of the entities that cross module borders, as DDL strings (they need no session to exist)."""

QA = (
    "qid STRING, category STRING, question STRING, relevant_chunk_ids ARRAY<STRING>, reference_answer STRING, "
    "requires_filter MAP<STRING,STRING>"
)
CHUNK = (
    "chunk_id STRING, paper_id STRING, title STRING, authors ARRAY<STRING>, year INT, category STRING, section STRING, "
    "chunk_index INT, text STRING, n_tokens INT"
)
FULL_TEXT = "paper_id STRING, full_text STRING"
TRACE_STEP = "STRUCT<thought: STRING, action: STRING, action_input: STRING, observation: STRING>"
ANSWER = (
    "qid STRING, question STRING, answer STRING, retrieved_chunk_ids ARRAY<STRING>, input_tokens BIGINT, output_tokens BIGINT, "
    "cached_input_tokens BIGINT, cache_creation_input_tokens BIGINT, latency_ms DOUBLE, extracted_filter MAP<STRING,STRING>, "
    f"tool_call_trace ARRAY<{TRACE_STEP}>"
)
