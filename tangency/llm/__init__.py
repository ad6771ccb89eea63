"""Operators that prepare training text at scale, each on plain DataFrames.

Nothing outside this subpackage imports it.
"""
