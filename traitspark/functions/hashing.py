"""Deterministic randomness from salted md5.

Every draw is a function of (seed, key), so it does not depend on how the
rows are partitioned, survives a recomputed task and can be checked in any
SQL engine. Hash integers or strings only: the text form of a double differs
between engines.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus of the affine draw family: the Mersenne prime 2**31 - 1, so that a
# product of two residues fits a 64-bit integer in every engine.
PRIME = 2147483647


def salted_md5(salt, *keys) -> Column:
    """``md5(salt:key1:key2...)`` as 32 hex digits."""
    salt_col = salt if isinstance(salt, Column) else F.lit(str(salt))
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", salt_col.cast("string"), *[p.cast("string") for p in parts]))


def hex_int(md5_col: Column, start: int = 1, digits: int = 8) -> Column:
    """Hex digits ``start .. start+digits-1`` of a hash as a bigint."""
    return F.conv(F.substring(md5_col, start, digits), 16, 10).cast("long")


def hex_bound(fraction: float) -> str:
    """Text bound ``b`` so that ``hash < b`` holds for ``fraction`` of all hashes.

    Hex text sorts like the number, so the filter needs no conversion.
    """
    if fraction >= 1:
        return "g"
    return format(int(fraction * 2**32), "08x")


def uniform(md5_col: Column, start: int = 1) -> Column:
    """Uniform number in [0, 1) from eight hex digits."""
    return hex_int(md5_col, start) / F.lit(4294967296.0)


def normal(md5_col: Column) -> Column:
    """Standard normal number from sixteen hex digits (Box-Muller)."""
    u1 = uniform(md5_col, 1)
    u2 = uniform(md5_col, 9)
    return F.sqrt(F.lit(-2.0) * F.ln(u1 + F.lit(1e-10))) * F.cos(F.lit(2.0) * F.pi() * u2)


def draw_constants(seed, n: int) -> list[tuple[int, int]]:
    """Slope and offset of the affine draw for each iteration ``1..n``."""
    out = []
    for i in range(1, n + 1):
        h = hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
        out.append((int(h[:8], 16) % (PRIME - 1) + 1, int(h[8:16], 16) % PRIME))
    return out


def residue(seed, *keys) -> Column:
    """Key hash reduced below :data:`PRIME`, the input of every affine draw."""
    return hex_int(salted_md5(seed, *keys)) % F.lit(PRIME)


def draw_limit(fraction: float) -> int:
    """Residues below this limit are drawn."""
    return int(fraction * PRIME)


# Steps that separate the repeats of one group (multipliers of classic
# congruential generators).
_STEP_A, _STEP_B = 48271, 16807


def fifth_power(x):
    """``x**5`` modulo :data:`PRIME`, a one-to-one map; columns or integer arrays below it.

    Every product stays below 2**62.
    """
    square = (x * x) % PRIME
    return ((square * square) % PRIME * x) % PRIME


def place_order(h, tie, group, turn):
    """Sort key that puts the rows of a group in the order of one turn (integer arrays).

    ``h`` and ``tie`` are two integers from the row key's hash, ``group`` one
    from the group's hash. A turn is an affine map of ``h`` with constants of
    its own, followed by the fifth power; rows with equal ``h`` are told apart
    by ``tie``.
    """
    a = fifth_power((group + turn * _STEP_A + 1) % PRIME) % (PRIME - 1) + 1
    b = fifth_power((group + turn * _STEP_B + 2) % PRIME)
    return fifth_power((h * a + b) % PRIME) * 4294967296 + tie


def place_steps(h: str, tie: str, group: str, turn: Column) -> list[tuple[str, Column]]:
    """:func:`place_order` as named column steps, to be added one after the other."""
    c = F.col
    return [
        ("_u", (c(group) + turn * _STEP_A + 1) % PRIME),
        ("_v", (c(group) + turn * _STEP_B + 2) % PRIME),
        ("_a", fifth_power(c("_u")) % (PRIME - 1) + 1),
        ("_b", fifth_power(c("_v"))),
        ("_x", (c(h) * c("_a") + c("_b")) % PRIME),
        # never null: a null test on it would be pushed below all the steps
        ("_order", F.coalesce(fifth_power(c("_x")) * 4294967296 + c(tie), F.lit(0))),
    ]
