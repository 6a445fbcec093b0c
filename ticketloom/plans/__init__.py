"""Ticket projection of the benchmark tables, query registry and SQL oracle."""
