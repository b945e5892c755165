"""Keyed operators: DataFrame in, DataFrame out, nothing runs inside."""
