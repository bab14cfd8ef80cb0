"""Query-log labelling, schema ranking and evaluation as Spark DataFrame jobs."""
