"""Property-graph and text analytics expressed as Spark DataFrame programs."""
