"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  ``lodestone.llm.registry``
lists its queries and SQL.
"""
