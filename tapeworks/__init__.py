"""Market-data analytics on Spark: ingest, bars, warehouse loads, features and forecasts."""
