"""Operators over updates in long form: a row for each group (round), client and coordinate."""
