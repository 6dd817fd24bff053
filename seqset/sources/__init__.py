"""Readers and writers: text lines, file lists, DDL catalogs, tag indexes."""
