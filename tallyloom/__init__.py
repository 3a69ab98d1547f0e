"""Table analytics as Spark DataFrame functions: cleaning, profiling, chart aggregates,
relative-time filters, key figures and linear forecasts."""
