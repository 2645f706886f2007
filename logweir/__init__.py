"""Log summarisation and event-log analytics on PySpark."""
