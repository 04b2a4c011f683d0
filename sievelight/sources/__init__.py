"""Span sources: document tables, raw pages, conversations, files behind optional providers, sinks."""
