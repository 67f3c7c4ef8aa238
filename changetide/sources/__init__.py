"""Readers and writers: broker topics, landed files, manifests, stored tables."""
