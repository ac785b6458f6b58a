"""Compact byte forms for what is exchanged between tasks: integer arrays, and tables of documents."""
import numpy as np
import pyarrow as pa
import zstandard


def pack(values):
    """A numpy integer array as compressed byte planes: high bytes of small numbers cost next to nothing."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T
    return values.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(body):
    dtype = np.dtype(body[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), np.uint8)
    return planes.reshape(dtype.itemsize, -1).T.copy().view(dtype).reshape(-1)


def pack_sorted(values):
    """Ascending unsigned numbers as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(body):
    values = unpack(body)
    return np.cumsum(values, dtype=values.dtype)


def pack_table(table):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_table(body):
    return pa.ipc.open_stream(body).read_all()
