"""Operators: DataFrame in, DataFrame out, nothing collected but model parameters."""
