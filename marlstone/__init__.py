"""Daily market data and news streams as PySpark plans."""
