"""Relational operators over any table: the columns' names are parameters."""
