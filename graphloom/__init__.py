"""graphloom: codebase-graph analytics and data processing on PySpark."""
