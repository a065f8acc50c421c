"""Sources and sinks: transaction views, CSV/parquet readers, fingerprints,
the processed-data cache and result sinks."""
from .views import TX_SCHEMA, read_table, tx_view, ev_view, read_transactions, normalize

__all__ = ["TX_SCHEMA", "read_table", "tx_view", "ev_view", "read_transactions", "normalize"]
