"""Plans over star models: joins along relationships, measures, levels of detail and row-level security."""
