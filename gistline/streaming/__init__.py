"""Structured Streaming twins of the jobs that the batch operators do over whole tables."""
