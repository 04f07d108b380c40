"""Operators for preparing training text at scale, and the queries that apply them.

Nothing outside this folder imports it. Each module holds one operator with its own general
interface; ``queries`` derives the registered digests from the operators' outputs.
"""
