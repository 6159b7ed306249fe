"""Table schemas, as DDL strings Spark readers and writers take directly."""

LINE_ITEMS = "array<struct<description: string, amount: double>>"

RECEIPT_TEXT = "source_file string, text string"

RECEIPTS = (
    "source_file string, vendor string, date string, total double, tax double, "
    f"currency string, line_items {LINE_ITEMS}, engine string, warnings array<string>, "
    "content_hash string, duplicate_of string, extraction_failed boolean"
)

RESPONSES = "source_file string, content_hash string, seq bigint, status int, body string"

CACHE = (
    "content_hash string, source_file string, vendor string, date string, currency string, "
    f"total double, tax double, engine string, line_items {LINE_ITEMS}, "
    "warnings array<string>, run_id bigint"
)

RUNS = (
    "started_at timestamp, files_processed bigint, flagged_count bigint, "
    "duplicate_count bigint, engine string, run_id bigint"
)

FLAGGED = (
    "item_id string, source_file string, vendor string, date string, total double, "
    "reason string, created_at timestamp, run_id bigint"
)

REVIEW_LOG = "item_id string, reviewed_at timestamp"

ALERTS = "text string, flagged_count bigint, run_id bigint"

# Every key of every original; `main` marks one of them.
KEY_INDEX = "key string, source_file string, main boolean, run_id bigint"

BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"

# The uploads that runs have worked on.
UPLOADS = "source_file string, arrived_at timestamp, seq bigint, run_id bigint"
