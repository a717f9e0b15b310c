"""Whole plans: the commands, and the queries of the entry point with their SQL."""
