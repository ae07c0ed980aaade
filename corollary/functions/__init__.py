"""Scalar functions of the rule language as JVM-side column expressions."""
