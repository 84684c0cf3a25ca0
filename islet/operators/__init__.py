"""Relational graph operators: edge-table algebra, component engines, census and generators."""
