"""Readers and writers of points, labels and records."""
