"""Training-data operators: thirteen large-scale operators and their queries.

Nothing outside this package imports it.
"""
