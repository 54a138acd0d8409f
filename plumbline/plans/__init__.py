"""Composite runs built from the operators."""
