"""Operators for large-scale training-data preparation.

Each module holds one operator with a general DataFrame interface;
``queries.py`` derives the registered ``opN_<name>`` digests from them.
Nothing outside this subpackage imports it.
"""
