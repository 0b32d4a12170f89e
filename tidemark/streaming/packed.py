"""Rows in a stream's state as compressed Arrow tables: one value for some thousands of rows, not one for each."""

from __future__ import annotations

import pyarrow as pa

CHUNK = 10_000


def pack(table: pa.Table) -> list[bytes]:
    """The rows in values of at most CHUNK rows each."""
    out = []
    for at in range(0, table.num_rows, CHUNK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table.slice(at, CHUNK).combine_chunks())
        out.append(sink.getvalue().to_pybytes())
    return out


def unpack(value: bytes) -> pa.Table:
    with pa.ipc.open_stream(value) as reader:
        return reader.read_all()
