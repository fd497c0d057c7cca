"""Scalar expressions over states, schedules and small tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..operators.ordering import BELL


def slot(key: Column, i: int) -> Column:
    """The value of slot i of a packed state."""
    return F.shiftrightunsigned(key, 4 * i).bitwiseAND(15) - 1


def with_slot(key: Column, i: int, value: int) -> Column:
    return key.bitwiseAND(F.lit(~(15 << (4 * i)))).bitwiseOR(F.lit((value + 1) << (4 * i)))


def introduced(key: Column, width: int) -> Column:
    """A fresh slot behind ``width`` others."""
    return key.bitwiseOR(F.lit(1 << (4 * width)))


def labels(conn: Column) -> Column:
    return F.array_distinct(F.filter(conn, lambda x: x > 0))


def label_count(conn: Column, label: Column) -> Column:
    return F.size(F.filter(conn, lambda x: x == label))


def renamed(conn: Column, old: Column, new: Column) -> Column:
    return F.transform(conn, lambda x: F.when(x == old, new).otherwise(x))


def without_slot(conn: Column, i: int) -> Column:
    return F.filter(conn, lambda x, p: p != i)


def bell(k: Column) -> Column:
    """Bell numbers, those beyond the table's last as the last."""
    numbers = F.array(*[F.lit(b) for b in BELL]) if max(BELL) >= 1 << 31 else F.array(*[F.lit(b).cast("int") for b in BELL])
    return F.element_at(numbers, F.greatest(F.lit(1), F.least(F.lit(len(BELL)), k + 1)).cast("int"))


def temperature(schedule: str, start: float, end: float, share: Column) -> Column:
    """An annealing temperature when ``share`` of the iterations is done."""
    return {
        "geometric": start * F.pow(F.lit(end / start), share),
        "linear": start + (end - start) * share,
        "cosine": end + (start - end) * (1 + F.cos(F.pi() * share)) / 2,
        "log": start / (1 + (start / end - 1) * F.log1p(share * (F.exp(F.lit(1.0)) - 1))),
    }[schedule]


def is_square(x: Column) -> Column:
    root = F.floor(F.sqrt(x))
    return root * root == x
