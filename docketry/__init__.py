"""Court-ruling analytics on Spark: text to fields, idempotent loads, list queries, judge analytics, ranked search."""
