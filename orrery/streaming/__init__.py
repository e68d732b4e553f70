"""Inserts, updates and deletes: batch readings of a change log, and the same as a stream."""
