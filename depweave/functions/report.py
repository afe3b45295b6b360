"""Text of a run summary."""

from pyspark.sql import functions as F

from depweave.schemas import STATUSES

# Fixed value: the layout of a report line.
REPORT_LAYOUT = "SchedulerResult{status=%s, executedTaskCount=%d, executionTime=%dmicro(s), exception=%s}"


def status_label(status):
    """The status itself when it is one of the five known labels, else ``Unknown``."""
    return F.when(status.isin(*STATUSES), status).otherwise(F.lit("Unknown"))


def report_line(status, executed, elapsed_us, error):
    """One line per summary; a failed run without a message reads ``unknown exception``."""
    shown = F.coalesce(
        error,
        F.when(status == "TaskFailed", F.lit("unknown exception")).otherwise(F.lit("none")),
    )
    zero = F.lit(0).cast("long")
    return F.format_string(
        REPORT_LAYOUT,
        status_label(status),
        F.coalesce(executed, zero),
        F.coalesce(elapsed_us, zero),
        shown,
    )
