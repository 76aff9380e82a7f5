"""Readers that turn files and tables into token and segment frames."""
