"""Training-data operators: each module is one operator with its own general interface.

Nothing outside this package imports it; ``queries.py`` binds the operators to
the tables for the entry module.
"""
