"""Named plans: KPI tables, chart / dashboard / workbook datasets, report
findings, the batch job and the SQL oracle."""
