"""Relational and image operators over labelled measurements."""
