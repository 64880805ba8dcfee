"""Readers and writers of files: opinions, drafts, metadata, libraries, journals, artifacts."""
