"""Context retrieval, selection, hygiene and quality analytics on PySpark DataFrames."""
