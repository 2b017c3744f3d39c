"""DataFrame -> DataFrame operators (profile, report, compare, charts, health,
features, preparation, models, conversations, ad-hoc SQL)."""
