"""Recursive-descent acceptors of the languages of source files, with panic-mode recovery."""
