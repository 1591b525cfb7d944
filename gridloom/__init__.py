"""Grouped residual analysis and training-data operators on Spark."""
