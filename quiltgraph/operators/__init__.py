"""Traversals, graph algorithms and analyses over edge tables."""
