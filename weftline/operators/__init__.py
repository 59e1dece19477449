"""Relational operators; every module works on DataFrames and leaves planning to Catalyst."""
