"""Operators of a training-data pipeline: token files, filters, duplicate
removal, search, mixing. Nothing else in the library imports this package."""
