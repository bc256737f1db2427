"""weftgraph: property-graph analytics on PySpark DataFrames."""
