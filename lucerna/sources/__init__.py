from lucerna.sources.tables import TABLES, Roles, load, read_table, role_summary

__all__ = ["TABLES", "Roles", "load", "read_table", "role_summary"]
