"""Refreshing from sources that grow; an addition of this library."""
