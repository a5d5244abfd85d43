"""Log analytics on Spark: parsing, filtering, statistics, alerts and span extraction as DataFrame jobs."""
