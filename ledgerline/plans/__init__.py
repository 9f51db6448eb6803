"""Registered queries: one per operator, each with the SQL it is held against."""
