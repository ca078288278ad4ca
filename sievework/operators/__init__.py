"""Relational operators: frames in, frames out."""
