"""Relational and graph operators over nodes and weighted edges."""
