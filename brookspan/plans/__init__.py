"""Registered queries, and plans made from operator descriptors."""
