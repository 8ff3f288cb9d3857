"""lectern: narrated-text analytics on PySpark."""
