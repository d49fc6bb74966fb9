"""glyphmill: document-run analytics on PySpark."""
