"""The registered queries, one per operator, with their SQL."""
