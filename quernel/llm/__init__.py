"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``quernel.llm.queries`` holds the
registered queries; each operator lives in a module of its own.
"""
