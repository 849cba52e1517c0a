"""Operators for preparing training data: one module an operator, queries in ``queries``."""
