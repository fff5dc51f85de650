"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it; ``pictora.llm.queries`` registers its queries.
"""
