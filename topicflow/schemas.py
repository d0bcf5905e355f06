"""Schemas of the tables the engine reads and writes, as DDL strings."""

# CSV corpora. Dates stay text here and are parsed with null on error.
CORPUS_A = "url STRING, title STRING, text STRING, topic STRING, tags STRING, date STRING"
CORPUS_B = (
    "source STRING, title STRING, text STRING, publication_date STRING, "
    "rubric STRING, subrubric STRING, tags STRING"
)
CORPUS = "doc_id BIGINT, title STRING, text STRING, topic STRING, date TIMESTAMP"

# A landed response of the news API: articles keep whatever fields they have
API_RESPONSE = "results ARRAY<VARIANT>"
ARTICLE_FIELDS = ("content", "description", "title", "pubDate", "source_id", "source", "link")

MESSAGES = "value BINARY, partition INT, offset BIGINT"
REJECTED = "partition INT, offset BIGINT, value BINARY, reason STRING"

INCOMING_NEWS = (
    "id STRING, external_id STRING, title STRING, source STRING, published_at TIMESTAMP, "
    "raw_text STRING, url STRING, payload_json STRING, created_at TIMESTAMP"
)
NEWS_STATUS = "id STRING, status STRING, error_message STRING, updated_at TIMESTAMP"
TOPIC_METADATA = (
    "cluster_id INT, label STRING, top_words ARRAY<STRING>, is_active BOOLEAN, updated_at TIMESTAMP"
)
CLUSTERING_REPORTS = (
    "id STRING, news_id STRING, cluster_id INT, cluster_label STRING, "
    "top_words_snapshot ARRAY<STRING>, score DOUBLE, created_at TIMESTAMP"
)
BATCH_LOG = "size BIGINT, processed BIGINT, unknown BIGINT, seconds DOUBLE"
PUBLISH_LOG = "fetched BIGINT, published BIGINT"
INGEST_LOG = "outcome STRING, n BIGINT"

EMBEDDINGS = "doc_id BIGINT, embedding ARRAY<FLOAT>"
ASSIGNMENTS = "doc_id BIGINT, cluster INT, score DOUBLE"
TOPICS = "cluster_id INT, rank INT, word STRING, score DOUBLE"
RUN_METRICS = "run_id STRING, metric STRING, value DOUBLE, text STRING"

NEW, PROCESSING, PROCESSED, FAILED = "new", "processing", "processed", "failed"
