"""Registered queries: operators wired to the canonical tables, each with the same rows as SQL where SQL can say it."""
