"""Relational operators on pools, event logs and texts."""
