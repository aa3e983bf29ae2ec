"""Sequences of labels as one 64-bit key.

A dictionary gives every known label a number from 1 up; 0 is NULL. The numbers of a sequence lie side by side in one
long, so a group-by hashes, compares and shuffles eight bytes in place of a string for every label. A sequence with a label that the
dictionary lacks, or a dictionary too large for the sequence's length, is carried as the labels themselves (``_other``):
exact, only wider. The dictionary therefore never changes a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY, OTHER = "_key", "_other"


def bits_of(labels: int, dictionary: tuple[str, ...]) -> int:
    """Bits of a label in a key of ``labels`` labels; 0 where the dictionary's numbers do not fit."""
    need = len(dictionary).bit_length()
    return need if need * labels <= 63 else 0


def pack(columns: list[Column], dictionary: tuple[str, ...]) -> list[Column]:
    """``_key`` (NULL where a label is unknown) and ``_other`` (the labels, NULL where there is a key)."""
    bits = bits_of(len(columns), dictionary)
    labels = F.array(*columns)
    if not bits:
        return [F.lit(None).cast("long").alias(KEY), labels.alias(OTHER)]
    numbers = F.create_map(*[x for k, v in enumerate(dictionary, 1) for x in (F.lit(v), F.lit(k).cast("long"))])
    # An unknown label finds NULL, and so does the sum with it.
    parts = [F.shiftleft(F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.element_at(numbers, c)), bits * i)
             for i, c in enumerate(columns)]
    known = reduce(lambda a, b: a & b, [c.isNull() | c.isin(*dictionary) for c in columns])
    return [reduce(lambda a, b: a.bitwiseOR(b), parts).alias(KEY), F.when(~known, labels).alias(OTHER)]


def unpack(names: list[str], dictionary: tuple[str, ...]) -> list[Column]:
    """The labels of :func:`pack`'s columns, in order, as ``names``."""
    bits = bits_of(len(names), dictionary)
    if not bits:
        return [F.get(OTHER, F.lit(i)).alias(n) for i, n in enumerate(names)]
    labels = F.array(F.lit(None).cast("string"), *[F.lit(v) for v in dictionary])
    mask = F.lit((1 << bits) - 1).cast("long")
    number = lambda i: F.shiftright(F.col(KEY), bits * i).bitwiseAND(mask).cast("int")
    return [F.when(F.col(KEY).isNull(), F.get(OTHER, F.lit(i))).otherwise(F.get(labels, number(i))).alias(n)
            for i, n in enumerate(names)]
