"""Operators over cell tables, panels, annual tables and predictions."""
