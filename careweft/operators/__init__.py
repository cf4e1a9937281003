"""Relational operators that keep working when one key holds much of the data."""
