"""Operators on tables of files and findings."""
