"""Scalar functions, as Columns and, for queries on the driver, as Python."""
