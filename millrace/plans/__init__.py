"""Decisions over metadata: plain Python on the driver."""
