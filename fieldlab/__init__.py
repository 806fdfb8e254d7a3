"""Scientific field, reaction and mesh analytics on PySpark."""
