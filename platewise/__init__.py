"""Analytics on real-time PCR plate runs as Spark DataFrame jobs."""
