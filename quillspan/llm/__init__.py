"""Operators for preparing training collections. Nothing outside this package imports it."""
