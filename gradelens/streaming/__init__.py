"""Scores kept current while answers arrive."""
