"""Confidence-arbitrated point-cloud and identity analytics on Spark DataFrames."""
