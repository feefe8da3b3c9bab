"""Stored tables: definitions, the catalog of snapshots, codecs, and the classes that users declare."""
