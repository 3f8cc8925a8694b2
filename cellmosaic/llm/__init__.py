"""Operators for large text corpora.

Each module holds one operator with a general interface; ``queries`` binds
them to the tables of the engine.  Nothing outside this package imports it.
"""
