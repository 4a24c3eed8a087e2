"""docspark: analytics of document text on Spark DataFrames."""
