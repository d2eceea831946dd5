"""Operators over DataFrames: pairs, trees, distances, features, diffs, clusters, their evaluation."""
