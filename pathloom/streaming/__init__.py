"""Incremental loading of mapping records with Structured Streaming; an extension, batch runs need none of it."""
