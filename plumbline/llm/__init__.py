"""Operators of a training-data pipeline: extraction, joins of near copies, filters, packing and mixing.

Nothing else in the library imports this package.
"""
