"""Placement of keyed messages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit FNV-1a offset basis and prime.
FNV_BASIS = 2166136261
FNV_PRIME = 16777619
FEW_KEYS = 32


def fnv1a32(key: Column) -> Column:
    """32-bit FNV-1a of the key bytes, as a signed INT.

    On Arrow batches, byte place by byte place over all keys that are that long; the few that are
    longer than nearly all others are finished one by one. The work is that of the bytes of the distinct keys.
    """
    basis, prime, few = FNV_BASIS, FNV_PRIME, FEW_KEYS

    @F.pandas_udf("int")
    def hashed(keys: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(keys)
        raw = sorted(((bytes(key), i) for i, key in enumerate(distinct)), key=lambda x: -len(x[0]))
        sizes = np.array([len(key) for key, _ in raw], dtype=np.int64)
        octets = np.frombuffer(b"".join(key for key, _ in raw), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        state = np.full(len(raw), basis, dtype=np.uint32)
        place = 0
        # Longest first, so the keys with a byte at ``place`` are the first ones.
        while (inside := int(np.searchsorted(-sizes, -place))) > few:
            state[:inside] = (state[:inside] ^ octets[starts[:inside] + place]) * np.uint32(prime)
            place += 1
        for i in range(inside):
            rest = int(state[i])
            for octet in raw[i][0][place:]:
                rest = (rest ^ octet) * prime & 0xFFFFFFFF
            state[i] = rest
        state[[i for _, i in raw]] = state.copy()
        found = np.append(state.view(np.int32), 0)  # the last place stands for a missing key
        return pd.Series(found[codes]).where(codes >= 0).astype("Int32")

    return hashed(key.cast("string").cast("binary"))


def key_partition(key: Column, n: Column | int, method: str = "spark") -> Column:
    """Partition of a key among ``n``: equal keys always meet.

    ``spark`` is the engine's own hash and stays inside generated code; ``fnv1a`` is the placement
    of common message producers, for records that have to join keys written by one. Records
    without a key share one partition.
    """
    count = F.lit(n) if isinstance(n, int) else n
    own = F.pmod(F.hash(key), count).cast("int")
    if method == "spark":
        return own
    if method != "fnv1a":
        raise ValueError(f"method must be 'spark' or 'fnv1a', not {method!r}")
    return F.coalesce(F.abs(fnv1a32(key).cast("bigint") % count).cast("int"), own)
