"""Readers, writers and the recogniser hook."""
