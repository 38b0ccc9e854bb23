"""SHA-256 with a state that can be handed from task to task (the digest has no parts that could be
taken apart and put together, but it can be left off and taken up)."""

from __future__ import annotations

import ctypes
import ctypes.util
import sys
from collections.abc import Iterable

from pyspark import cloudpickle

STATE_BYTES = 112  # SHA256_CTX of libcrypto: plain words, no pointers

# Tasks take up the state, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def library():
    """libcrypto, which Python's own hashlib uses; None where there is none."""
    try:
        found = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")
        found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        return found
    except (OSError, AttributeError):
        return None


def begin() -> bytes:
    held = ctypes.create_string_buffer(STATE_BYTES)
    library().SHA256_Init(held)
    return held.raw


def proceed(state: bytes, parts: Iterable[bytes]) -> bytes:
    held, lib = ctypes.create_string_buffer(state, STATE_BYTES), library()
    for part in parts:
        lib.SHA256_Update(held, part, len(part))
    return held.raw


def finish(state: bytes) -> str:
    held, out = ctypes.create_string_buffer(state, STATE_BYTES), ctypes.create_string_buffer(32)
    library().SHA256_Final(out, held)
    return out.raw.hex()


def join_lines(batches):
    """Lines (``at, line``) of a batch as pieces ``at, n, size, bytes``: each line with its end."""
    import pyarrow as pa

    seen: dict[int, int] = {}
    for b in batches:
        starts, lines, i = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
        while i < len(starts):
            j, at = i, starts[i]
            while j < len(starts) and starts[j] == at:
                j += 1
            whole = b"\n".join(lines[i:j]) + b"\n"
            seen[at] = seen.get(at, -1) + 1
            yield pa.RecordBatch.from_pydict(
                {"at": pa.array([at], pa.int64()), "n": pa.array([seen[at]], pa.int64()), "size": pa.array([len(whole)], pa.int64()), "bytes": pa.array([whole], pa.binary())}
            )
            i = j


def step(state: bytes, first: bool):
    """A task that takes up ``state`` with its pieces in order. The last line end of a piece is left
    to the next one, since the last line of a file may have none."""

    def run(batches):
        import pyarrow as pa

        held, started = state, not first
        for b in batches:
            for piece in b.column(0).to_pylist():
                held = proceed(held, [b"\n", piece[:-1]] if started else [piece[:-1]])
                started = True
        yield pa.RecordBatch.from_pydict({"state": pa.array([held], pa.binary())})

    return run
