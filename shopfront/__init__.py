"""Lead-opportunity analytics over local-business data, written as Spark jobs."""
