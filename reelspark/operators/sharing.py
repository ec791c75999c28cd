"""Pairs of places that members share within some years, without a row a member and pair.

A task counts a block of places against all others in a dense array: members of
few stays come as their distinct pairs, the others as lists of stays, so one that
was nearly everywhere costs neither a join nor a shuffle of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf
from .blocks import read_table, spread
from .graphs import number

#: Entries of a task's counts; stays of a member that comes as pairs, at most; pairs formed, and counts given, at once.
COUNTS, FEW, AT_ONCE = 16_000_000, 256, 500_000


def shared_places(stays: DataFrame, shelf: Shelf, years: int = 2) -> DataFrame:
    """(place_a, place_b, n), place_a < place_b: members with stays at both at most ``years`` apart, of distinct (member, year, place)."""
    stays = shelf.put(stays, "stays")
    ids = number(stays.select(F.col("place").alias("node")).distinct().orderBy("node"), shelf, "places")
    n, names_at = ids.count(), f"{shelf.root}/places"
    size = max(1, min(COUNTS // max(1, n), -(-n // 24)))
    lists = stays.join(ids.toDF("place", "i"), "place").groupBy("member").agg(F.collect_list("i").alias("i"), F.collect_list("year").alias("t"))
    few_most, at_once = FEW, AT_ONCE

    def few(x: pd.DataFrame, k: np.ndarray) -> Iterator[pd.DataFrame]:
        i, t = (np.concatenate([np.asarray(v, np.int64) for v in x[c]]) for c in "it")
        member = np.repeat(np.arange(len(k)), k)
        first = np.cumsum(k) - k
        src, dst = np.repeat(np.arange(len(i)), k[member]), spread(first[member], k[member])
        near = (i[src] < i[dst]) & (np.abs(t[src] - t[dst]) <= years)
        src, dst = src[near], dst[near]
        pair = np.sort(np.unique((member[src] * n + i[src]) * n + i[dst]) % (n * n))
        u, v = pair // n, pair % n
        b = u // size
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        for p, q in zip(at, np.r_[at[1:], len(b)], strict=False):
            yield pd.DataFrame([{"b": b[p], "u": u[p:q].astype("i4").tobytes(), "v": v[p:q].astype("i4").tobytes(), "t": None}])

    def many(i: np.ndarray, t: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.argsort(i, kind="stable")
        i, t = np.asarray(i)[order], np.asarray(t)[order]
        for b in np.unique(i // size):  # pairs are counted at their smaller place
            p = np.searchsorted(i, b * size)
            yield pd.DataFrame([{"b": b, "u": None, "v": i[p:].astype("i4").tobytes(), "t": t[p:].astype("i4").tobytes()}])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            k = x["i"].map(len).to_numpy(np.int64)
            small = k <= few_most
            xs, ks = x[small], k[small]
            part = np.cumsum(ks * ks) // at_once
            for p in np.unique(part):
                yield from few(xs[part == p], ks[part == p])
            for i, t in zip(x["i"][~small], x["t"][~small], strict=True):
                yield from many(i, t)

    def add(counts: np.ndarray, lo: int, place: np.ndarray, t: np.ndarray) -> None:
        own, at = np.unique(place, return_inverse=True)
        year, when = np.unique(t, return_inverse=True)
        there = np.zeros((len(year), len(own)), bool)
        there[when, at] = True
        around = np.stack([there[np.abs(year - y) <= years].any(axis=0) for y in year])
        first = np.searchsorted(at, np.arange(len(own) + 1))  # stays come in order of places
        for j in range(np.searchsorted(own, lo + len(counts))):
            near = around[when[first[j] : first[j + 1]], j + 1 :].any(axis=0)
            counts[own[j] - lo, own[j + 1 :][near]] += 1

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = cur = counts = None

        def given() -> Iterator:
            step = max(1, at_once // n)
            for p in range(0, len(counts), step):
                u, v = np.nonzero(counts[p : p + step])
                for q in range(0, len(u), at_once):
                    a, c = u[q : q + at_once], v[q : q + at_once]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(cur * size + p + a)), names.take(pa.array(c)), pa.array(counts[p + a, c].astype(np.int64))], ["place_a", "place_b", "n"])

        for batch in batches:
            for r in batch.to_pylist():
                if names is None:
                    table = read_table(names_at, ["node", "i"])
                    names = pa.concat_arrays(table.column("node").chunks).take(pa.array(np.argsort(table.column("i").to_numpy())))
                if r["b"] != cur:
                    if cur is not None:
                        yield from given()
                    cur = r["b"]
                    counts = np.zeros((min(size, n - cur * size), n), np.int32)
                v = np.frombuffer(r["v"], "i4")
                if r["t"] is None:
                    np.add.at(counts.reshape(-1), (np.frombuffer(r["u"], "i4") - cur * size) * np.int64(n) + v, 1)
                else:
                    add(counts, cur * size, v, np.frombuffer(r["t"], "i4"))
        if cur is not None:
            yield from given()

    sent = lists.mapInPandas(send, "b long, u binary, v binary, t binary")
    return sent.repartition(max(1, -(-n // size)), "b").sortWithinPartitions("b").mapInArrow(count, "place_a string, place_b string, n long")
