"""Loomwork: Spark jobs over collections of files, documents and records."""
