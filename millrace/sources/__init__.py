"""Readers of dumps, exports, logs, archives and CSV files."""
