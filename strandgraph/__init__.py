"""strandgraph: temporal dependency-graph analytics as PySpark plans."""
