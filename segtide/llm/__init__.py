"""Operators of a training-data pipeline: one module for each, and the check queries of all ten.

Nothing outside this subpackage imports it. Every operator is a function from DataFrame to
DataFrame; ``doc_id`` and ``text`` are the columns it needs unless its docstring names others.
"""
