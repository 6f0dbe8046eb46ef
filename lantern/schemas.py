"""Schemas of the records that the library reads and writes."""

ARTICLE = "title string, text string, category string, url string, aliases array<string>, competition string"
CHUNK = "text string, source string, chunk_id int, category string, section_title string, is_lead boolean, url string, aliases array<string>"
#: Known keys of a log row's extras; the row keeps the raw text beside them.
EXTRAS = (
    "struct<probs:map<string,double>,margin:double,n_passages:int,top_source:string,top_score:double,gated_by_min_score:boolean,min_score_threshold:double,category_filter:string,reranked:boolean,hybrid:boolean,"
    "multi_query:boolean,query:string,passages:array<struct<source:string,chunk_id:int,score:double,text_preview:string>>,live_search_fired:boolean,live_search_latency:double,live_top_score:double,live_provider:string,"
    "live_all_below_threshold:boolean,tool:string,expr:string,result:string,tier_selected:string,escalated:boolean>"
)
QUESTION = (
    "run_kind string, run_id string, ts string, session_id string, competition_id bigint, competition_name string, level bigint, question_text string, options array<string>, chosen_index bigint, chosen_text string, "
    "correct boolean, timed_out boolean, latency_seconds double, strategy string, confidence double, probs map<string,double>, extras string"
)
GOLD = "question_text string, options array<string>, correct_index bigint, competition_id bigint, level bigint, category string, source_run string"
RETRIEVAL_GOLD = GOLD + ", gold_article_title string, candidates array<string>"
REPORT = "strategy_name string, accuracy double, ece double, latency_p50 double, latency_p95 double, n_total bigint"
MANIFEST = "embedder string, dim int, query_prefix string, passage_prefix string, normalize boolean, chunk_size int, overlap int, corpus_version int"
