"""Readers and writers: labelled pairs, models, reports."""
