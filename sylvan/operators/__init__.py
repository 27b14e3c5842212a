"""Relational kernels of the trainer as DataFrame queries."""
