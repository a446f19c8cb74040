"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Each module holds one operator with
its general interface; ``queries`` applies them to the synthetic tables.
"""
