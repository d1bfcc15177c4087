"""factorspark: panel analytics, similarity graphs and factor backtests as Spark plans."""
