"""The status lattice of jobs and the orders that views of it use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The statuses in their order, the final ones and the legal moves.
STATUSES = ("Scheduled", "Pending", "Running", "Retrying", "AwaitingApproval", "Cancelling", "Completed", "Failed", "Cancelled", "Skipped")
TERMINAL = ("Completed", "Failed", "Cancelled", "Skipped")
EDGES = {
    "Pending": ("Running", "Cancelling", "Failed"),
    "Running": ("Completed", "Failed", "Retrying", "AwaitingApproval", "Cancelling"),
    "Retrying": ("Running", "Cancelling"),
    "AwaitingApproval": ("Running", "Failed", "Cancelling"),
    "Cancelling": ("Cancelled",),
}


def allowed(before: str, after: str) -> bool:
    return after in EDGES.get(before, ())


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def legal(before: Column, after: Column) -> Column:
    """True where the move is one of the legal ones, or where there is nothing before."""
    moves = [F.concat_ws(">", before, after).isin(*[f"{a}>{b}" for a, bs in EDGES.items() for b in bs])]
    return before.isNull() | moves[0]


def rank(status: Column) -> Column:
    """0 waiting, 1 at work, 2 being cancelled, 3 final: views never go down."""
    return F.when(status.isin("Scheduled", "Pending"), 0).when(status.isin("Running", "Retrying", "AwaitingApproval"), 1).when(status == "Cancelling", 2).otherwise(3)
