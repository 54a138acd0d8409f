"""Readers, view registration, document and export parsing, sinks."""
