"""Operators of the form ``op(df, ...) -> DataFrame``."""
