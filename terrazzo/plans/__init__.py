"""Queries over the given tables, each applying operators to a stand-in for scene data, and their SQL."""
