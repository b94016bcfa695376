"""recollect: long-term memory analytics as Spark plans."""
