"""Registered queries by area, each with SQL that computes the same rows from the same tables."""
