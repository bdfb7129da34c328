"""Lattica subpackage."""
