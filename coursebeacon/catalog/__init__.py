"""Registered queries over the relational test tables, and their SQL counterparts."""
