"""Where log rows come from and go to."""

from logmere.sources.logs import import_nanos, list_data_files, read_logs
from logmere.sources.wire import encode, read_wire, write_wire

__all__ = [
    "encode",
    "import_nanos",
    "list_data_files",
    "read_logs",
    "read_wire",
    "write_wire",
]
