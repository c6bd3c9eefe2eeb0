"""Readers and writers: topics, tables, image stores."""
