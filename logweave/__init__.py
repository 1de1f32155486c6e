"""Machine-log analytics on PySpark: ingest, field extraction, search, roll-ups and alerts."""
