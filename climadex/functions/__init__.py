"""Scalar expressions, all of them built-in Spark functions."""
