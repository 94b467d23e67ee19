"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library working.
"""
