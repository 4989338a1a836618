"""Reusable DataFrame operators: filters, top lists, shares, sinks."""
