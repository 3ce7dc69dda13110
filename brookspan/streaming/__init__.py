"""Stateful streaming operators that emit changelogs, and helpers to run and replay streams."""
