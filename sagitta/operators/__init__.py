"""Operators over tables of exchange matrices."""
