"""Registered queries: operators applied to the star-schema tables under fixed roles."""
