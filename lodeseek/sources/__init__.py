"""Readers and writers around the DataFrame operators."""
