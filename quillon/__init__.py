"""Quillon: region, context and corpus pipelines on Spark DataFrames."""
