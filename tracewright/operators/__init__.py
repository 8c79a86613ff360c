"""Dataflow operators over fact tables."""
