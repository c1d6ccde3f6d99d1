"""Pieces of DuckDB SQL that several queries' checks share."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text (0 for null), bit by bit, as DuckDB has no function for it."""
    bits = "list_reduce([xor(h, c) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT))"
    return f"xor(4294967295, list_reduce({codes}, lambda h, c: xor(h >> 8, {bits})))"
