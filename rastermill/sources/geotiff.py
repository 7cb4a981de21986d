"""Minimal GeoTIFF: uncompressed or deflate strips/tiles of one type, pixel scale and tie point; enough for round trips.

Decoding runs on executors, a block at a time; one file is one task, so large images are written as a folder of files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..grid import GridMeta

#: TIFF field types as (struct code, bytes).
TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
FORMATS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def encode(data: np.ndarray, grid: GridMeta, compress: bool = True, rows_per_strip: int = 64) -> bytes:
    """data: bands x rows x cols, planar strips."""
    bands, height, width = data.shape
    data = np.ascontiguousarray(data.astype(data.dtype.newbyteorder("<")))
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    strips = [data[b, r : r + rows_per_strip].tobytes() for b in range(bands) for r in range(0, height, rows_per_strip)]
    strips = [zlib.compress(s, 6) for s in strips] if compress else strips
    geographic = 4000 <= grid.crs < 5000
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, grid.crs]
    tags: list[tuple[int, int, list]] = [
        (256, 4, [width]), (257, 4, [height]), (258, 3, [data.dtype.itemsize * 8] * bands), (259, 3, [8 if compress else 1]), (262, 3, [1]),
        (273, 4, None), (277, 3, [bands]), (278, 4, [rows_per_strip]), (279, 4, [len(s) for s in strips]), (284, 3, [2 if bands > 1 else 1]),
        (339, 3, [kind] * bands), (33550, 12, [grid.cellx, grid.celly, 0.0]), (33922, 12, [0.0, 0.0, 0.0, grid.left, grid.top, 0.0]), (34735, 3, keys),
    ]
    if grid.nodata is not None:
        tags.append((42113, 2, [bytes([c]) for c in f"{grid.nodata:g}\0".encode()]))
    at = 8 + 2 + 12 * len(tags) + 4
    sizes = [(len(v) if v is not None else len(strips)) * TYPES[t][1] for _, t, v in tags]
    places = []
    for s in sizes:
        places.append(at if s > 4 else None)
        at += s + s % 2 if s > 4 else 0
    offsets = [at + sum(map(len, strips[:i])) for i in range(len(strips))] if len(strips) < 2 else [at, *(at + int(x) for x in np.cumsum([len(s) for s in strips])[:-1])]
    head, extra = [struct.pack("<2sHI", b"II", 42, 8), struct.pack("<H", len(tags))], []
    for (tag, t, values), size, place in zip(tags, sizes, places, strict=True):
        values = offsets if values is None else values
        raw = struct.pack(f"<{len(values)}{TYPES[t][0]}", *values)
        head.append(struct.pack("<HHI", tag, t, len(values)) + (raw.ljust(4, b"\0") if place is None else struct.pack("<I", place)))
        if place is not None:
            extra.append(raw + b"\0" * (size % 2))
    return b"".join([*head, struct.pack("<I", 0), *extra, *strips])


def header(raw: bytes) -> tuple[dict, GridMeta]:
    """(layout of the blocks, grid) from a file's tags; no cell is decoded."""
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    magic, first = struct.unpack(f"{order}HI", raw[2:8])
    if magic != 42:
        raise ValueError("not a classic TIFF")
    (n,) = struct.unpack(f"{order}H", raw[first : first + 2])
    tags = {}
    for i in range(n):
        tag, t, count, value = struct.unpack(f"{order}HHI4s", raw[first + 2 + 12 * i : first + 14 + 12 * i])
        if t in TYPES:
            code, size = TYPES[t]
            place = struct.unpack(f"{order}I", value)[0]
            body = value[: size * count] if size * count <= 4 else raw[place : place + size * count]
            tags[tag] = struct.unpack(f"{order}{count * len(code)}{code[0]}", body)
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    dtype = np.dtype(FORMATS[tags.get(339, (1,))[0], tags[258][0]]).newbyteorder(order)
    compression, predictor, planar = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(284, (1,))[0]
    if compression not in (1, 8, 32946) or predictor != 1:
        raise ValueError(f"compression {compression} with predictor {predictor} is not supported")
    tiled = 322 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (width, tags.get(278, (height,))[0])
    offsets, lengths = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    sx, sy = tags.get(33550, (1.0, 1.0))[:2]
    tie = tags.get(33922, (0.0,) * 6)
    keys = tags.get(34735, ())
    crs = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), 4326)
    nodata = b"".join(tags[42113]).rstrip(b"\0 ").decode() if 42113 in tags else None
    grid = GridMeta(tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx, sy, height, width, int(crs), tuple(str(b + 1) for b in range(bands)), float(nodata) if nodata else None, dtype.newbyteorder("=").name)
    layout = {"dtype": dtype, "packed": compression != 1, "planar": planar == 2, "tiled": tiled, "tw": tw, "th": th, "offsets": offsets, "lengths": lengths}
    return layout, grid


def blocks(raw: bytes, layout: dict, grid: GridMeta):
    """(row, column, bands x rows x cols) of each block, one at a time."""
    tw, th, bands = layout["tw"], layout["th"], len(grid.bands)
    across, down = -(-grid.ncols // tw), -(-grid.nrows // th)
    for place in range(across * down):
        r, c = place // across * th, place % across * tw
        rows = th if layout["tiled"] else min(th, grid.nrows - r)
        parts = []
        for k in range(place, len(layout["offsets"]), across * down) if layout["planar"] else (place,):
            body = raw[layout["offsets"][k] : layout["offsets"][k] + layout["lengths"][k]]
            body = zlib.decompress(body) if layout["packed"] else body
            per = 1 if layout["planar"] else bands
            parts.append(np.frombuffer(body, layout["dtype"], rows * tw * per).reshape(rows, tw, per)[: grid.nrows - r, : grid.ncols - c])
        yield r, c, np.concatenate(parts, 2).transpose(2, 0, 1)


def decode(raw: bytes) -> tuple[np.ndarray, GridMeta]:
    """(bands x rows x cols, grid)."""
    layout, grid = header(raw)
    out = np.empty((len(grid.bands), grid.nrows, grid.ncols), grid.dtype)
    for r, c, part in blocks(raw, layout, grid):
        out[:, r : r + part.shape[1], c : c + part.shape[2]] = part
    return out, grid
