"""folioflow: a document-analytics engine expressed as Spark DataFrames."""
