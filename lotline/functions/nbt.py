"""Item trees (NBT, gzipped or not) as flat maps: the attributes that filters look at.

A tree is read by the tag types of the format, over Arrow batches: Spark has no function for it.
"""

from __future__ import annotations

import gzip
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: tag types
END, BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, BYTES, STRING, LIST, COMPOUND, INTS, LONGS = range(13)
NUMBERS = {BYTE: ">b", SHORT: ">h", INT: ">i", LONG: ">q", FLOAT: ">f", DOUBLE: ">d"}
ARRAYS = {BYTES: "b", INTS: "i", LONGS: "q"}


def _text(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from(">H", data, at)[0]
    return data[at + 2 : at + 2 + n].decode("utf-8", "replace"), at + 2 + n


def flattened(data: bytes) -> dict[str, str]:
    """Every value of a tree by its path: names joined by dots, places of a list from 0. Numbers and texts as
    text, arrays as numbers joined by commas; an empty list or compound has no value. The root's own name is
    not part of a path."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out: dict[str, str] = {}
    try:
        kind, at = data[0], 1
        if kind != COMPOUND:
            raise ValueError(f"the root has type {kind}")
        at = _text(data, at)[1]
        # what is open, innermost last: path, and of a list the type of its items, the next one and how many
        todo: list[list] = [["", None, 0, 0]]
        while todo:
            path, item, place, n_items = todo[-1]
            if item is None:
                kind, at = data[at], at + 1
                if kind == END:
                    todo.pop()
                    continue
                name, at = _text(data, at)
            else:
                if place == n_items:
                    todo.pop()
                    continue
                kind, name = item, str(place)
                todo[-1][2] += 1
            key = f"{path}.{name}" if path else name
            if kind in NUMBERS:
                value = struct.unpack_from(NUMBERS[kind], data, at)[0]
                out[key], at = str(value), at + struct.calcsize(NUMBERS[kind])
            elif kind == STRING:
                out[key], at = _text(data, at)
            elif kind in ARRAYS:
                n = struct.unpack_from(">i", data, at)[0]
                form = f">{n}{ARRAYS[kind]}"
                out[key], at = ",".join(map(str, struct.unpack_from(form, data, at + 4))), at + 4 + struct.calcsize(form)
            elif kind == LIST:
                of, n = struct.unpack_from(">bi", data, at)
                at += 5
                todo.append([key, of, 0, max(n, 0)])
            elif kind == COMPOUND:
                todo.append([key, None, 0, 0])
            else:
                raise ValueError(f"tag type {kind}")
    except (IndexError, struct.error) as e:
        raise ValueError("the tree is cut off") from e
    return out


def tree(value: dict, name: str = "") -> bytes:
    """A tree of dicts (compounds), lists, texts, ints (as long, if they need it, else int), floats (double) and
    bytes. An item of a list has the type of the first."""

    def kind(x) -> int:
        if isinstance(x, dict):
            return COMPOUND
        if isinstance(x, list):
            return LIST
        if isinstance(x, str):
            return STRING
        if isinstance(x, bytes):
            return BYTES
        return DOUBLE if isinstance(x, float) else INT if -(1 << 31) <= x < 1 << 31 else LONG

    def text(x: str) -> bytes:
        return struct.pack(">H", len(x.encode())) + x.encode()

    def body(x, k: int) -> bytes:
        if k == COMPOUND:
            return b"".join(bytes([kind(v)]) + text(n) + body(v, kind(v)) for n, v in x.items()) + b"\0"
        if k == LIST:
            of = kind(x[0]) if x else END
            return struct.pack(">bi", of, len(x)) + b"".join(body(v, of) for v in x)
        if k == STRING:
            return text(x)
        if k == BYTES:
            return struct.pack(">i", len(x)) + x
        return struct.pack(NUMBERS[k], x)

    return bytes([COMPOUND]) + text(name) + body(value, COMPOUND)


def _flatten(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None or len(x) == 0 else flattened(bytes(x)))


def attributes(data: Column) -> Column:
    """flattened() of a binary column; null and empty are null, what is no tree raises."""
    return F.pandas_udf(_flatten, "map<string,string>")(data)
