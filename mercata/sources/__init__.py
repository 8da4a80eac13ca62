"""Readers and writers of the documents and tables the jobs work on."""
