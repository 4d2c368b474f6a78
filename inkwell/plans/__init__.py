"""Registered queries: operators on the tables, each with the SQL of its result."""
