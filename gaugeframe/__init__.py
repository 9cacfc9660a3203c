"""gaugeframe: profile tables, embed their rows, judge the vectors, all as Spark DataFrame jobs."""
