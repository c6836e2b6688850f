"""DataFrame -> DataFrame operators keyed by symbol and date."""
