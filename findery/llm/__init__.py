"""Operators for preparing language-model training data at scale.

Nothing else in the library imports this subpackage. ``findery.llm.registry``
lists its queries and their SQL.
"""
