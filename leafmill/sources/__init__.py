"""Readers that turn files into line, page and block tables."""
