"""Multi-tenant product-event analytics, written as Spark DataFrame jobs."""
