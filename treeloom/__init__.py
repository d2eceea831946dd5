"""Tree-similarity analytics on Spark."""
