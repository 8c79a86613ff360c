"""Readers and writers of source trees, catalogs and stores."""
