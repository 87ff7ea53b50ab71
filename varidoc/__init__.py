"""Document analytics on Spark: dynamically typed documents in DataFrame columns."""
