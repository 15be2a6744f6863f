"""Training-data operators: thirteen large-corpus building blocks on PySpark.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
