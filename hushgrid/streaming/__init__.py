"""Streams of edits: debounce, scans of each quiet state, diagnostics, and a cache of verifications."""
