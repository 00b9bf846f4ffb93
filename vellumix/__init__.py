"""vellumix: corpus analytics on PySpark."""
