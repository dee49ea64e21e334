"""Incremental versions of the batch jobs."""
