"""Queue status codes, job flags and the predicates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Queue status letter, code and name.
STATUS_LETTERS = {"U": 0, "I": 1, "R": 2, "X": 3, "C": 4, "H": 5, "E": 6}
STATUS_NAMES = {
    0: "Unexpanded",
    1: "Idle",
    2: "Running",
    3: "Removed",
    4: "Completed",
    5: "Held",
    6: "Submission_err",
}
UNKNOWN_STATUS = -1
ACTIVE_STATUSES = (1, 2)
ERROR_STATUSES = (5, 6)

# Job flag names, the flag is the position.
FLAG_NAMES = [
    "GOT_SUBMITTED",
    "NOT_STARTED",
    "IN_HTCONDOR",
    "HTCONDOR_ERROR",
    "EXITED",
    "GOOD_EXITCODE",
    "BAD_EXITCODE",
    "NO_EXITCODE",
]
GOT_SUBMITTED, NOT_STARTED, IN_QUEUE, QUEUE_ERROR, EXITED, GOOD_EXIT, BAD_EXIT, NO_EXIT = range(8)
FAILURE_FLAGS = (QUEUE_ERROR, BAD_EXIT, NO_EXIT)


def _lookup(table: dict, key: Column) -> Column:
    cells = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*cells), key)


def status_code(letter: Column) -> Column:
    """Code of a status letter, -1 for any other text."""
    return F.coalesce(_lookup(STATUS_LETTERS, letter), F.lit(UNKNOWN_STATUS))


def status_name(code: Column) -> Column:
    """Name of a status code; null stays null, an undefined code is 'Unknown'."""
    return F.when(code.isNotNull(), F.coalesce(_lookup(STATUS_NAMES, code), F.lit("Unknown")))


def _flag_tests(status: Column, has_log: Column, has_out: Column, exitcode: Column) -> list:
    """(flag, test) pairs in the order in which a job lists its flags."""
    log, out = F.coalesce(has_log, F.lit(False)), F.coalesce(has_out, F.lit(False))
    return [
        (IN_QUEUE, status.isNotNull()),
        (QUEUE_ERROR, status.isin(*ERROR_STATUSES)),
        (GOT_SUBMITTED, log),
        (NOT_STARTED, ~log),
        (EXITED, out),
        (GOOD_EXIT, exitcode == 0),
        (BAD_EXIT, exitcode != 0),
        (NO_EXIT, exitcode.isNull()),
    ]


def job_flags(status: Column, has_log: Column, has_out: Column, exitcode: Column) -> Column:
    """Flags of one job in their fixed order.

    `status` is null when the job is not queued, `exitcode` is null when no readable exit
    record exists. The two evidence columns may be null, which means absent.
    """
    tests = _flag_tests(status, has_log, has_out, exitcode)
    return F.array_compact(F.array(*[F.when(test, F.lit(flag)) for flag, test in tests]))


def evidence_names(status: Column, has_log: Column, has_out: Column, exitcode: Column) -> Column:
    """`flag_names` of `job_flags` without the array in between."""
    tests = _flag_tests(status, has_log, has_out, exitcode)
    return F.concat_ws(",", *[F.when(test, F.lit(FLAG_NAMES[flag])) for flag, test in tests])


def flag_names(flags: Column) -> Column:
    """Comma-joined flag names."""
    names = F.array(*[F.lit(name) for name in FLAG_NAMES])
    return F.array_join(F.transform(flags, lambda flag: F.get(names, flag)), ",")


def _rule(queued: Column, in_error: Column, good: Column) -> dict[str, Column]:
    """The three verdicts and the class a job counts under: good before failed before running.

    A job is running while it is queued and not in an error status. It has failed if it is not
    running and is in error or without a good exit record.
    """
    running = queued & ~in_error
    failed = ~running & (in_error | ~good)
    outcome = F.when(good, F.lit("good")).when(failed, F.lit("failed")).otherwise(F.lit("running"))
    return {"running": running, "failed": failed, "success": good, "outcome": outcome}


def _in_error(status: Column) -> Column:
    return F.coalesce(status.isin(*ERROR_STATUSES), F.lit(False))


def verdicts(status: Column, exitcode: Column) -> dict[str, Column]:
    """`running`, `failed`, `success` and `outcome` from the evidence itself, in generated code."""
    good = F.coalesce(exitcode == 0, F.lit(False))
    return _rule(status.isNotNull(), _in_error(status), good)


def _of_flags(flags: Column, status: Column) -> dict[str, Column]:
    good = F.array_contains(flags, GOOD_EXIT)
    return _rule(F.array_contains(flags, IN_QUEUE), _in_error(status), good)


def is_running(flags: Column, status: Column) -> Column:
    """In the queue and not in an error status, whatever else the status is."""
    return _of_flags(flags, status)["running"]


def is_failed(flags: Column, status: Column) -> Column:
    return _of_flags(flags, status)["failed"]


def is_success(flags: Column) -> Column:
    return F.array_contains(flags, GOOD_EXIT)


def outcome(flags: Column, status: Column) -> Column:
    return _of_flags(flags, status)["outcome"]


def effective_proc_id(resubmitted: Column, recorded: Column) -> Column:
    """The proc id a job works under: that of the job it replaces, else its own, else 0."""
    return F.coalesce(resubmitted, recorded, F.lit(0))
