"""Registered queries, their SQL counterparts and session helpers."""
