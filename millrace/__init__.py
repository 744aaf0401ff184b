"""millrace: ordered data-loading pipelines, statistics and parsers expressed as Spark plans."""
