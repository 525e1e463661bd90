"""Scalar functions as Catalyst columns."""
