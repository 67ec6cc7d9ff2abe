"""strataloom: evidence tables and training-data operators as Spark plans."""
