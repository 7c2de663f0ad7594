"""Logical schemas of the tables the jobs read and write."""

REQUESTS = (
    "request_id BIGINT, raw STRING, query STRING, max_results BIGINT, output_formats ARRAY<STRING>, "
    "request_timeout_secs BIGINT, remove_elements_css_selector STRING, html_transformer STRING, "
    "serp_proxy_group STRING, serp_max_retries BIGINT, scraping_tool STRING, max_request_retries BIGINT, "
    "dynamic_content_wait_secs BIGINT, desired_concurrency BIGINT, proxy_configuration STRING, "
    "readable_text_char_threshold BIGINT, remove_cookie_warnings BOOLEAN, debug_mode BOOLEAN"
)
PAGES = "page_id BIGINT, url STRING, html STRING"
FETCHED_PAGES = (
    "url STRING, loaded_url STRING, status INT, content_type STRING, error STRING, html STRING, loaded_at TIMESTAMP"
)
EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
SEARCH_RESULT = "struct<title:string,description:string,url:string,rank:bigint,result_type:string>"
#: Stage times of one request in the order they were taken: microseconds, and since the one before.
MEASURES = "array<struct<event:string,time_us:bigint,delta_us:bigint>>"
DEBUG = f"struct<time_measures:{MEASURES}>"
RESULTS = (
    "response_id STRING, unique_key STRING, query STRING, text STRING, html STRING, markdown STRING, "
    "crawl STRUCT<created_at:TIMESTAMP,http_status_code:INT,http_status_message:STRING,"
    f"loaded_at:TIMESTAMP,request_status:STRING,unique_key:STRING,debug:{DEBUG}>, "
    "search_result STRUCT<title:STRING,description:STRING,url:STRING,rank:BIGINT,result_type:STRING>, "
    "metadata STRUCT<title:STRING,url:STRING,redirected_url:STRING,description:STRING,"
    "author:STRING,language_code:STRING>"
)
