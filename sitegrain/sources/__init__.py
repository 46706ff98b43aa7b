"""Readers: seed lists, task files, fetch logs, raw page files."""
