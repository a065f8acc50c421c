"""DataFrame operators.  Each takes and returns DataFrames; the heavy work
(scans, aggregates, joins, windows) runs on executors."""
