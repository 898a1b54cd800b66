"""Fixture views, query catalog, SQL oracle and the end-to-end flows."""
