"""Readers and writers: recordings, catalogs, caches and result bundles."""
