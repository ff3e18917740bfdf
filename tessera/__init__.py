"""Recombination analytics on Spark, and operators that prepare training data."""
