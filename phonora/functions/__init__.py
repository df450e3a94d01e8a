"""Scalar functions as Column builders, and the Arrow functions that Spark has no expression for."""
