"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it; its queries are listed in ``spindrift.llm.queries``.
"""
