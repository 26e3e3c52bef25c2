"""loomgraph: a code-knowledge-graph analytics engine on Spark DataFrames."""
