"""Fields of a landed server log line ``host:file.csv:<csv record>``.

The csv record starts with a timestamp (itself holding two colons); field 4 is
``p<pid>`` and field 10 the session id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mark a line.
PANIC_MARK = '"PANIC"'
TERMINATED_MARK = "was terminated by signal"
STATEMENT_ECHO = "EXECUTE E"
INTERNAL_ERROR_MARK = "internal error"
OUT_OF_MEMORY_MARK = "Out of memory"


def _piece(text: Column, sep: str, n: int) -> Column:
    """The n-th piece (n > 1), '' when there are fewer; touches only the text up to it."""
    before = F.substring_index(text, sep, n - 1)
    piece = F.substring_index(F.substring_index(text, sep, n), sep, -1)
    return F.when(F.octet_length(before) < F.octet_length(text), piece).otherwise("")


def hostname(line: Column) -> Column:
    return F.substring_index(line, ":", 1)


def log_file(line: Column) -> Column:
    return _piece(line, ":", 2)


def log_time(line: Column) -> Column:
    """Timestamp text as logged, zone included: the last two colons before the first comma are its own."""
    return F.substring_index(F.substring_index(line, ",", 1), ":", -3)


def log_ts(line: Column) -> Column:
    """Logged local time; null when the line does not carry one."""
    return time_of(log_time(line))


def time_of(logtime: Column) -> Column:
    return F.substring_index(logtime, " ", 2).try_cast("timestamp_ntz")


def process_id(line: Column) -> Column:
    return F.substr(_piece(line, ",", 4), F.lit(2)).try_cast("int")


def session_id(line: Column) -> Column:
    return _piece(line, ",", 10)


def message(line: Column) -> Column:
    """Everything after ``.csv:``."""
    return F.substr(line, F.instr(line, ".csv") + 5)


def is_panic(line: Column) -> Column:
    return line.contains(PANIC_MARK) & ~line.contains(STATEMENT_ECHO)


def is_terminated(line: Column) -> Column:
    return line.contains(TERMINATED_MARK) & ~line.contains(STATEMENT_ECHO)


def terminated_pid(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"\(PID (\d+)\)", 1), F.lit("")).try_cast("int")
