"""Readers: files and tables to canonical events."""
