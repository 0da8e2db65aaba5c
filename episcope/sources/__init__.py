"""Readers, guards on what was read, sinks and file layout."""
