"""Whole queries over the engine's operators."""
