"""Graph, text and vector analytics over knowledge-graph tables, on PySpark."""
