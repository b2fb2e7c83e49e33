"""A Spark-first engine for content analytics: text, HTML, URLs, features, models, a content store and crawl state."""
