"""Signal and evidence analytics on PySpark."""
