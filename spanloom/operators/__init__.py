"""Operators from events to episodes, ranks, roll-ups, waste, flame events, redaction and audits."""
