"""Pictures decoded into pixels: a decoder for each format, blue, green and red.

DECODERS is the place for more formats; those here need NumPy only. Grey pictures get
three equal channels, alpha is left out, 16-bit samples keep their upper byte.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Decoder = Callable[[bytes], np.ndarray]
#: A PNM header: magic, width, height and the largest sample, between which comments may stand.
_GAP = rb"(?:\s+|#[^\n]*\n)+"
_PNM = re.compile(rb"(P[2356])" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)\s")


def decode_pnm(content: bytes) -> np.ndarray:
    """Grey and colour maps, as bytes or as text."""
    head = _PNM.match(content)
    if not head:
        raise ValueError("no PNM header")
    kind, width, height, most = head[1], *(int(head[i]) for i in (2, 3, 4))
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not 0 < most < 1 << 16 or not width * height:
        raise ValueError("no PNM header")
    n = width * height * channels
    if kind in (b"P2", b"P3"):
        x = np.array(re.sub(rb"#[^\n]*", b"", content[head.end() :]).split()[:n], np.int64)
    else:
        x = np.frombuffer(content, ">u2" if most > 255 else np.uint8, count=-1 if most < 256 else (len(content) - head.end()) // 2, offset=head.end())[:n]
    if len(x) < n:
        raise ValueError("too few samples")
    x = (x >> 8 if most > 255 else x).astype(np.uint8).reshape(height, width, channels)
    return x[..., ::-1] if channels == 3 else x


def decode_bmp(content: bytes) -> np.ndarray:
    """Uncompressed bitmaps of 8 bits with a palette, of 24 and of 32 bits."""
    number = lambda at, size=4, signed=False: int.from_bytes(content[at : at + size], "little", signed=signed)
    start, header, width, height, bits, packed = number(10), number(14), number(18, signed=True), number(22, signed=True), number(28, 2), number(30)
    if packed or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("not this kind of bitmap")
    stride = (width * bits + 31) // 32 * 4
    x = np.frombuffer(content, np.uint8, count=stride * abs(height), offset=start).reshape(abs(height), stride)[:, : width * bits // 8].reshape(abs(height), width, -1)
    if height > 0:  # rows from the bottom up
        x = x[::-1]
    if bits == 8:
        colours = number(46) or 256
        palette = np.frombuffer(content, np.uint8, count=4 * colours, offset=14 + header).reshape(-1, 4)
        x = palette[x[..., 0]]
    return x[..., :3]


#: Decoders by the first bytes of a file, the longest match first.
DECODERS: dict[bytes, Decoder] = {**{b"P" + d: decode_pnm for d in (b"2", b"3", b"5", b"6")}, b"BM": decode_bmp}


def decode(content: bytes | None, decoders: dict[bytes, Decoder] | None = None) -> np.ndarray | None:
    """Height, width and three channels of bytes, or None for what can't be read."""
    decoders = DECODERS if decoders is None else decoders
    found = next((d for magic, d in sorted(decoders.items(), key=lambda x: -len(x[0])) if content and content.startswith(magic)), None)
    if found is None:
        return None
    try:
        x = found(content)
    except (ValueError, IndexError, OverflowError, TypeError):
        return None
    return np.ascontiguousarray(x.repeat(3, -1) if x.shape[-1] == 1 else x[..., :3])


def _decoded(batches, decoders: dict[bytes, Decoder], column: str):
    for batch in batches:
        for i in range(batch.num_rows):  # a picture at a time: each is large
            x = decode(batch.column(column)[i].as_py(), decoders)
            more = (None, None, None) if x is None else (x.shape[0], x.shape[1], x.tobytes())
            row = batch.slice(i, 1)
            kept = [c for c in row.schema.names if c != column]
            arrays = [row.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(more[:1], pa.int32()), pa.array(more[1:2], pa.int32()), pa.array(more[2:], pa.binary())], [*kept, "height", "width", "bgr"])


def decoded(files: DataFrame, column: str = "content", decoders: dict[bytes, Decoder] | None = None) -> DataFrame:
    """Files with height, width and pixels (`bgr`, row by row) in place of their bytes; nulls for what can't be read."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != column)
    return files.mapInArrow(partial(_decoded, decoders=DECODERS if decoders is None else decoders, column=column), f"{kept}, height int, width int, bgr binary")
