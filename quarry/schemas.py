"""Row shapes. Order is never implicit: ordinals, indexes and ranks are columns."""

DOCUMENT = "doc_id string, source_path string, text string, preprocessor_name string"
CHUNK = "chunk_id string, doc_id string, chunk_idx int, text string, chunker_name string, metadata map<string,string>"
QUERY = "query_id bigint, original_query string, processed_queries array<string>, processor_name string, query_type string"
HIT = "query_id bigint, rank int, chunk_id string, text string, retrieval_score double, reranking_score double"
QA = "user_input string, reference string"
TABLE = "struct<start_page:int,end_page:int,table_index:int,caption:string,data:array<array<string>>>"
BOUNDARIES = "doc_id string, text_hash string, boundary_ids array<int>"
