"""shiplens — fulfillment and parcel-cost analytics as Spark DataFrame plans.

Layout:
  sources/    readers and writers (raw CSV, test-table adapter, KPI sinks)
  functions/  column helpers (null-safe flags, keyed noise, rounding, text)
  operators/  DataFrame -> DataFrame steps (filters, enrichment, aggregates,
              Pareto, surge, scenario, reshapes)
  plans/      named queries (KPI tables, chart/workbook datasets, insights),
              the batch job and the SQL oracle
  streaming/  the enrichment step as a Structured Streaming job
"""

__all__ = ["config"]
