"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Each ``opN_*`` module holds one
operator with its own general interface and a thin ``query`` that applies it to
a table of the synthetic data set.
"""
