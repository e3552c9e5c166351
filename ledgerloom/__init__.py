"""Contract-graph analytics on Spark: sources, operators, plans and streaming jobs as DataFrame programs."""
