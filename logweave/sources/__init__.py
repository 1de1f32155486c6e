"""Readers for raw lines, syslog text, rule libraries and the stored log table."""
