"""Batch jobs that read and write tables."""
