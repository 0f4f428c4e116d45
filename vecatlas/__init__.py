"""vecatlas: catalogue and embedding analytics on PySpark."""
