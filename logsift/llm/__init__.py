"""Operators of a training-data pipeline: one module each, with the queries in ``registry``."""
