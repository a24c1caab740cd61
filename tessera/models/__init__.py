"""Probabilistic models of model-sized networks; their data stays in Spark."""
