"""Runs the library on the star-schema test tables."""
