"""Deterministic 32-bit hashes as expressions on longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv1a(text: Column, seed: int = 0) -> Column:
    """FNV-1a over the characters, seeded by exclusive or."""
    return F.aggregate(_codes(text), F.lit(2166136261 ^ seed).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(MASK)))


def times31(text: Column, seed: int = 0) -> Column:
    return F.aggregate(_codes(text), F.lit(seed).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(MASK)))


def unit(text: Column, seed: int = 0) -> Column:
    """[0, 1) from the upper 24 bits of the FNV hash."""
    return F.shiftright(fnv1a(text, seed), 8) / F.lit(16777216.0)


def multiply32(x: Column, c: int) -> Column:
    """x * c modulo 2 ** 32, without overflow of 64 bits."""
    low = x.bitwiseAND(F.lit(65535)) * c
    high = F.shiftright(x, 16) * c
    return (low + F.shiftleft(high.bitwiseAND(F.lit(65535)), 16)).bitwiseAND(F.lit(MASK))


def finalise(x: Column) -> Column:
    """Murmur's 32-bit finaliser."""
    x = multiply32(x.bitwiseXOR(F.shiftright(x, 16)), 0x85EBCA6B)
    x = multiply32(x.bitwiseXOR(F.shiftright(x, 13)), 0xC2B2AE35)
    return x.bitwiseXOR(F.shiftright(x, 16))


def lcg(x: Column) -> Column:
    return (x * 1664525 + 1013904223).bitwiseAND(F.lit(MASK))
