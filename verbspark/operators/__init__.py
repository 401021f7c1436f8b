"""The verbs, grouped by what they change."""
