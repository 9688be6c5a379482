"""Readers and writers for documents, request bodies, column metadata and catalog snapshots."""
