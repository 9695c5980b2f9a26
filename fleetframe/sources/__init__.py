"""Readers, parsers and writers of the files around a fleet of jobs."""
