"""Declared schemas of all stored tables. Nothing is ever inferred."""

from pyspark.sql import types as T

PAGES_RAW = "id string, pageid string, title string, text string, url string"
PAGES = "id string, title string, text string, url string"
DOCS = (
    "doc_id string, title string, text string, authors array<string>, year int, "
    "cited_by array<string>, reference_ids array<string>"
)
QUERIES = (
    "query_id string, text string, authors array<string>, year int, "
    "cited_by array<string>, reference_ids array<string>"
)
QRELS = "query_id string, doc_id string, relevance int, iteration string"
DOC_META = "faiss_id bigint, doc_id string, title string, year int"
CHUNK_META = "faiss_id bigint, doc_id string, title string, url string, text string"
VECTORS = "faiss_id bigint, shard string, embedding array<float>"
MANIFEST = (
    "embedding_model string, dim int, shard string, first_id bigint, next_id bigint, count bigint"
)
HITS = "query_id string, faiss_id bigint, score double"
RESPONSES = (
    "run_id string, model string, query_id string, response_text string, prompt_tokens int, "
    "reasoning_tokens int, completion_tokens int, latency_ms double, request_error string"
)
RESULTS = (
    "run_id string, ts timestamp, model string, reasoning string, query_id string, "
    "query_text string, k int, retrieved string, response_json string, response_text string, "
    "selected_index int, selected_doc_id string, parse_error string, "
    "any_relevant_in_topk boolean, correct boolean, usage_prompt_tokens int, "
    "usage_reasoning_tokens int, usage_completion_tokens int, latency_ms double"
)
PRICES = "tier string, name string, cost_per_mtok_in double, cost_per_mtok_out double"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def columns(ddl: str) -> list[str]:
    return struct(ddl).fieldNames()
