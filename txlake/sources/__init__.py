"""Scans: landing files, event logs, transactional tables, and the sample tables."""
