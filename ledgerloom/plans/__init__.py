"""Registered queries over the operators, with their SQL."""
