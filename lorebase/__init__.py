"""lorebase: long-lived agent memory as Spark DataFrame jobs."""
