"""Fixture tables, registered queries and their SQL oracles."""
