"""The content store's six tables: one schema each, creation and removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_STAMPS = "created_at timestamp_ntz, updated_at timestamp_ntz"
#: In the order in which they refer to each other.
TABLES: dict[str, str] = {
    "domains": f"id string NOT NULL, name string NOT NULL, description string, keywords map<string,double>, auto_detected boolean, confidence double, {_STAMPS}",
    "content_items": f"id long NOT NULL, title string, content string NOT NULL, content_type string NOT NULL, meta_data string, url string NOT NULL, view_count int, similarity_hash string, status string, {_STAMPS}, indexed_at timestamp_ntz",
    "experts": f"id long NOT NULL, name string NOT NULL, bio string, expertise map<string,double>, rating double, answers_count int, profile_url string, avatar_url string, {_STAMPS}",
    "answers": f"id long NOT NULL, content_id long NOT NULL, expert_id long NOT NULL, text string NOT NULL, rating double, status string, {_STAMPS}",
    "domain_content": f"id long NOT NULL, domain_id string NOT NULL, content_id long NOT NULL, relevance_score double, {_STAMPS}",
    "expert_domain": f"id long NOT NULL, expert_id long NOT NULL, domain_id string NOT NULL, confidence_score double, {_STAMPS}",
}
#: What the enumerated columns may hold.
CONTENT_TYPES = ["question", "article", "profile", "other"]
CONTENT_STATES = ["active", "archived", "processing", "error"]
ANSWER_STATES = ["active", "archived", "hidden"]
#: Foreign keys: table -> {column: table it refers to}.
REFERENCES = {
    "answers": {"content_id": "content_items", "expert_id": "experts"},
    "domain_content": {"domain_id": "domains", "content_id": "content_items"},
    "expert_domain": {"expert_id": "experts", "domain_id": "domains"},
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Creates the tables that are missing; returns all names."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return list(TABLES)


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    for name in reversed(TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def recreate_tables(spark: SparkSession, database: str = "default") -> list[str]:
    drop_tables(spark, database)
    return create_tables(spark, database)
