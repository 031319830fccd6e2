"""Daily market panels and news signals as Spark jobs."""
