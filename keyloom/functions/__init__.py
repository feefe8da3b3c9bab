"""Scalar expressions: the accepted dialect and JSON paths."""
