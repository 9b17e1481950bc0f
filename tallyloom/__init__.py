"""Survey editing, imputation and allocation as Spark DataFrame jobs."""
