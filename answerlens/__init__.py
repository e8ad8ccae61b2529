"""answerlens: analytics over AI model answers and page captures, as Spark DataFrame jobs."""
