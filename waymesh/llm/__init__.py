"""Operators on texts: token ids, mixtures by token budget, personal information.

Nothing outside this subpackage imports it.
"""
