"""Operators for preparing text, web pages and vectors at corpus scale.

Nothing outside this subpackage imports it.
"""
