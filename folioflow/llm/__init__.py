"""Operators for training-data pipelines over ``documents`` and ``benchmark``.

Nothing outside this subpackage imports it.
"""
