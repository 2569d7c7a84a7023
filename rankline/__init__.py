"""rankline: a posting pipeline (normalise, match, gate, upsert, classify, dedup,
score, list) expressed as Spark DataFrame and Structured Streaming operators."""

__version__ = "0.1.0"
