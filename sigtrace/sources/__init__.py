"""Readers, writers and the shared folder of a run."""
