"""Log analytics on Spark: text to events, typed queries, statistics, comparisons and insights."""
