"""tessera: panel analytics, forecast validation and corpus preparation as Spark plans."""
