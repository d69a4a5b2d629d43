"""DataFrame -> DataFrame operators (filters, enrichment, lookups, measures,
Pareto, surge, scenario levers, reshapes)."""
