"""Content and catalog analytics on Spark: named, composable DataFrame operators."""
