"""Operators for preparing large text corpora.

Each module holds one operator with a general DataFrame-in, DataFrame-out
interface.  ``registry`` lists the queries built on them.  Nothing outside this
subpackage imports it.
"""
