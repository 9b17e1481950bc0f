"""Operators: ``(DataFrame, parameters) -> DataFrame``."""
