"""Word lists, patterns, weights, thresholds and message formats.

Everything in this package is plain data that results must agree with.  No module here
contains logic; the functions that use the values take them as default arguments so that a
caller can pass tables of their own.
"""
