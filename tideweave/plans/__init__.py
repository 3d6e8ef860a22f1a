"""Queries over the supplied tables and the SQL that gives the same rows."""
