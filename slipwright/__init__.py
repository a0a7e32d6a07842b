"""Receipt reconstruction and corpus preparation as Spark DataFrame jobs."""
