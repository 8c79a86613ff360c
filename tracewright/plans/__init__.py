"""Registered queries and the projections that feed them."""
