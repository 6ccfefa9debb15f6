"""weftgraph: knowledge-graph construction and retrieval as Spark DataFrames."""
