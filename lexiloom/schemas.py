"""Declared schemas of the tables and files."""

USERS = (
    "user_id LONG, username STRING, email STRING, password STRING, created_at TIMESTAMP_NTZ, "
    "updated_at TIMESTAMP_NTZ, last_login TIMESTAMP_NTZ, is_active BOOLEAN, credits LONG, account_type STRING"
)
TRANSACTIONS = (
    "id LONG, user_id LONG, amount DECIMAL(10,2), transaction_type STRING, created_at TIMESTAMP_NTZ, "
    "payment_method STRING"
)
HISTORY = (
    "id LONG, user_id LONG, input_text STRING, output_text STRING, source_language STRING, "
    "target_language STRING, created_at TIMESTAMP_NTZ, character_count INT, credits_used DECIMAL(10,2)"
)
PAYMENTS = (
    "order_code LONG, user_id LONG, amount INT, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
CONFIG = (
    "id INT, name_web STRING, address_web STRING, logo_link STRING, api_key STRING, name_owner STRING, "
    "phone_1 STRING, phone_2 STRING, google_map_link STRING, price INT, address STRING, email STRING"
)
LEDGER_TABLES = {
    "users": USERS,
    "credit_transactions": TRANSACTIONS,
    "translation_history": HISTORY,
    "payment_transactions": PAYMENTS,
    "config": CONFIG,
}

RUNS = (
    "doc STRING, part STRING, part_kind STRING, para_idx INT, run_idx INT, text_idx INT, text STRING, error STRING"
)
POINTS = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"

JOB_STATUS = (
    "id STRING, status STRING, progress INT, started_at DOUBLE, updated_at DOUBLE, filename STRING, "
    "target_language STRING, style STRING, model STRING, temperature DOUBLE, workers INT, message STRING, "
    "estimated_time_remaining DOUBLE, elapsed_time DOUBLE, error STRING, "
    "document_analysis STRUCT<num_paragraphs: INT, num_text_elements: INT, num_runs: INT, "
    "avg_text_length: DOUBLE, special_paragraphs: INT, needs_text_grouping: BOOLEAN, error: STRING>, "
    "processing_details STRUCT<current_step: STRING, total_paragraphs: INT, processed_paragraphs: INT, "
    "total_files: INT, processed_files: INT, cache_stats: STRUCT<hits: INT, misses: INT, total_requests: INT, "
    "hit_rate: DOUBLE, cache_size: INT>>, "
    "progress_display STRUCT<progress_bar: STRING, stage_info: STRING, current_item: STRING, "
    "elapsed_time_str: STRING, eta_str: STRING, speed: STRING, terminal_style: STRING>"
)
