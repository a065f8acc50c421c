"""ledgerflow: transaction-sequence analytics expressed as Spark DataFrame plans.

Transactions ``(user_id, date, brand, amount)`` are bucketed into tumbling
intervals, users are split into train / val / test cohorts, encoders are
fitted on the train input window, and per-user input sequences and next
interval targets are built, batched, scored and evaluated -- all as
DataFrame / SQL expressions that Catalyst plans and executors run.
"""

__version__ = "0.1.0"

# Version string that keys the processed-data cache (replaces hashing of
# source files): bump it whenever the meaning of a processed table changes.
PIPELINE_VERSION = "ledgerflow-1"
