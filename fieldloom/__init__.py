"""Synthesis, field extraction and evaluation of lease contracts, planned by Catalyst."""

__version__ = "0.1.0"
