from patronage.sources.transactions import (
    TRANSACTION_SCHEMA, LogRead, read_log, read_transactions, parse_invoice_dates, parse_lines, write_csv,
    transactions_from_star, transactions_from_events, load_log, read_table)
from patronage.sources.sinks import (
    write_marketing_outputs, append_metrics, append_run, read_metrics, read_runs)

__all__ = [
    "TRANSACTION_SCHEMA", "LogRead", "read_log", "read_transactions", "parse_invoice_dates", "parse_lines", "write_csv",
    "transactions_from_star", "transactions_from_events", "load_log", "read_table",
    "write_marketing_outputs", "append_metrics", "append_run", "read_metrics", "read_runs",
]
