"""Registered queries with their SQL counterparts, one per operator."""
