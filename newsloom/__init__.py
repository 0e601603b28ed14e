"""newsloom: news curation as Spark jobs (DataFrame / SQL / MLlib / Structured Streaming)."""

__version__ = "0.1.0"
