"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Every module holds one operator with a general DataFrame
interface; ``queries`` binds them to the contract columns that the driver asks for.
"""
