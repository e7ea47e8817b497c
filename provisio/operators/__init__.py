"""Relational operators of the reserving method (long form: Branche, Exercice, value)."""
