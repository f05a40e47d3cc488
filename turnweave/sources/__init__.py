"""Readers and writers of transcripts, corpora and object stores."""
