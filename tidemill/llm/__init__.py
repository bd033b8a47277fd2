"""Operators on collections of documents and on very large numeric columns. Nothing else in the library imports this."""
