"""trivalent: three-valued screening analytics on PySpark."""
