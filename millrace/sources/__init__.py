"""Readers and writers of pool formats."""
