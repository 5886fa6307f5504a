"""Operators for large training corpora.

Every module here stands alone on Spark's public API; nothing else in the
library imports this subpackage.
"""
