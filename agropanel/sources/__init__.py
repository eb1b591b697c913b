"""Readers, source-name rules, inventories and sinks."""
