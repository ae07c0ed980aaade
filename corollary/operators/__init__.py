"""Operators on relations outside the rule language."""
