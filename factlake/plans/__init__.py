"""Ready-made jobs: the fact table derived from raw tables, and one query per operator."""
