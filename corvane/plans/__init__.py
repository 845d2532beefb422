"""Registered queries and the SQL to hold them against."""
