"""Document-graph analytics written as ordinary Spark DataFrame operators."""
