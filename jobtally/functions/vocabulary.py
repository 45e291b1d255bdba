"""The operation vocabulary: names, short names, membership."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (short name, long name) of every operation, in report order.
OPERATION_NAMES = (
    ("ops", "ops"),
    ("cr", "create"),
    ("op", "open"),
    ("cl", "close"),
    ("mn", "mknod"),
    ("ln", "link"),
    ("ul", "unlink"),
    ("mk", "mkdir"),
    ("rm", "rmdir"),
    ("mv", "rename"),
    ("ga", "getattr"),
    ("sa", "setattr"),
    ("gx", "getxattr"),
    ("sx", "setxattr"),
    ("st", "statfs"),
    ("sy", "sync"),
    ("rd", "read"),
    ("wr", "write"),
    ("pu", "punch"),
    ("mi", "migrate"),
    ("fa", "fallocate"),
    ("dt", "destroy"),
    ("gi", "get_info"),
    ("si", "set_info"),
    ("qc", "quotactl"),
    ("pa", "prealloc"),
    ("rb", "read_bytes"),
    ("wb", "write_bytes"),
)

# The operations shown when the user has picked none.
DEFAULT_OPERATIONS = (
    "read", "write", "open", "close", "getattr", "setattr", "punch", "read_bytes", "write_bytes",
)

# Byte counters, merged only when histograms are wanted.
BYTE_OPERATIONS = ("read_bytes", "write_bytes")

TOTAL = "ops"
LONG_NAMES = tuple(long for _, long in OPERATION_NAMES)
SHORT_BY_LONG = {long: short for short, long in OPERATION_NAMES}
LONG_BY_SHORT = dict(OPERATION_NAMES)


def check_operation(name: str) -> str:
    """Return ``name`` if it may be sorted by, raise otherwise."""
    if name not in SHORT_BY_LONG:
        raise ValueError(f"unknown operation {name!r}; expected one of {', '.join(LONG_NAMES)}")
    return name


def is_known(operation: Column) -> Column:
    """True for the 28 vocabulary names (the total ``ops`` included)."""
    return operation.isin(*LONG_NAMES)


def _lookup(names: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
    return F.try_element_at(table, key)


def short_name(operation: Column) -> Column:
    """Two-letter name; unknown operations keep their first four characters."""
    return F.coalesce(_lookup(SHORT_BY_LONG, operation), F.left(operation, F.lit(4)))


def long_name(short: Column) -> Column:
    """Long name of a two-letter name; anything else is returned unchanged."""
    return F.coalesce(_lookup(LONG_BY_SHORT, short), short)
