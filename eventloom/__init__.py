"""Product-event analytics on PySpark: sources, models, checks, table upkeep, streams."""
