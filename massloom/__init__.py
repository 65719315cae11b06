"""massloom: a PySpark engine for spectrum-match tables and the data work around them."""
