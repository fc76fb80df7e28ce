"""Learners, the scheme language, models as expressions."""
