"""Readers, flatteners and writers of JSON shards, manifests and truth files."""
