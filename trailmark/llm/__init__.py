"""Operators for preparing training text, images of vectors and conversations at scale.

Nothing outside this subpackage imports it; its queries are registered by
``trailmark.llm.queries``.
"""
