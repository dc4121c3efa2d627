"""Readers and writers of the data sets' formats."""
