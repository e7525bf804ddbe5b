"""Content conversion and analytics on PySpark."""
