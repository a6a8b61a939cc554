"""Percentiles of large groups from dyadic Count-sketches that add up over parts and support deletions.

A value is encoded as an integer of BITS bits: value * scale where that is below a quarter of the range, on either side of
zero; beyond it, steps of the logarithm, so every finite value has a code and codes are in the order of the values. Level l of the sketch counts the nodes
code >> l. Levels with at most 2**EXACT_BITS nodes are kept exactly, as one array from which the coarser ones
follow; each finer level is a signed sketch of DEPTH rows and WIDTH cells. All of it is linear: sketches of parts
(partitions, days, files) are added, and rows of negative weight take rows back. A quantile descends from the
exact level: at each level the left child's count, the median of its signed cells, tells whether the rank lies left.

Stated error: a level's estimate deviates by about sqrt(F2 / WIDTH), F2 being the sum of the squared node
counts of that level within the group; with the defaults the rank of an answer is off by less than 1 % of n (tests).
The value is exact to 1/scale up to 134,217.727 (with the defaults) on either side of zero, and to one part in 100,000 beyond.

A part whose distinct values are few travels as its (code, weight) pairs, of which the sketch is a linear
function; it becomes cells when it has more than PAIRS of them. Every answer comes from the cells.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, EXACT_BITS, DEPTH, WIDTH, PAIRS = 29, 10, 5, 512, 4096
#: Octaves that the codes beyond the exact ones are for: all that a double has.
OCTAVES = 1_100
#: Rows that a task collects before it emits the parts of its groups.
CHUNK_ROWS = 400_000


class Shape:
    """The layout of a sketch: first the exact level, then for each level from 0 on its DEPTH rows."""

    def __init__(self, bits: int = BITS, exact_bits: int = EXACT_BITS, depth: int = DEPTH, width: int = WIDTH, seed: int = 7):
        self.bits, self.exact_bits, self.depth, self.width = bits, min(bits, exact_bits), depth, width
        self.levels = bits - self.exact_bits
        self.exact = 1 << self.exact_bits
        self.cells = self.exact + self.levels * depth * width
        self.seeds = np.random.default_rng(seed).integers(1, 2**63, size=(self.levels, depth), dtype=np.uint64)
        self.shift = np.uint64(64 - int(np.log2(width)))

    def encoded(self, value: Column, scale: int) -> Column:
        """The code of a number that isn't null or NaN. The middle of the range is zero, the inner half holds the values times scale, the rest their logarithms."""
        inner, middle = 1 << (self.bits - 2), 1 << (self.bits - 1)
        size = F.abs(value.cast("double")) * F.lit(float(scale))
        beyond = F.least(F.floor(F.log2(size / F.lit(float(inner))) * F.lit(inner / OCTAVES)), F.lit(inner - 1)) + F.lit(inner)
        step = F.when(size < inner - 0.5, F.abs(F.round(value * F.lit(scale)))).otherwise(F.greatest(beyond, F.lit(inner))).cast("bigint")
        return F.lit(middle) + F.when(value < 0, -step).otherwise(step)

    def decoded(self, codes: np.ndarray, scale: int) -> np.ndarray:
        """The values of codes."""
        inner, middle = 1 << (self.bits - 2), 1 << (self.bits - 1)
        step = np.asarray(codes, np.int64) - middle
        size = np.abs(step).astype(np.float64)
        with np.errstate(over="ignore"):
            far = inner * np.exp2((size - inner + 0.5) / (inner / OCTAVES))
        return np.where(size < inner, step / scale, np.sign(step) * far / scale)

    def hashed(self, level: int, row: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and sign (+1, -1) of nodes."""
        x = nodes.astype(np.uint64) + self.seeds[level, row]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return (x >> self.shift).astype(np.int64), 1 - 2 * (x & np.uint64(1)).astype(np.int64)

    def fold(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The cells of a multiset."""
        out = np.zeros(self.cells, np.int64)
        out[: self.exact] = np.bincount(codes >> self.levels, weights, self.exact).astype(np.int64)
        at = self.exact
        for level in range(self.levels):
            nodes, inverse = np.unique(codes >> level, return_inverse=True)
            w = np.bincount(inverse, weights, len(nodes))
            for row in range(self.depth):
                cell, sign = self.hashed(level, row, nodes)
                out[at : at + self.width] = np.rint(np.bincount(cell, w * sign, self.width)).astype(np.int64)
                at += self.width
        return out

    def descend(self, cells: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """For each rank from 1 to n, the code at which the descent ends."""
        sums = np.cumsum(cells[: self.exact])
        node = np.minimum(np.searchsorted(sums, ranks, side="left"), self.exact - 1)
        rest = ranks - (sums[node] - cells[node])
        size = cells[node].astype(np.float64)
        for level in range(self.levels - 1, -1, -1):
            at, left, est = self.exact + level * self.depth * self.width, 2 * node, []
            for row in range(self.depth):
                for child, own in ((left, True), (left + 1, False)):
                    cell, sign = self.hashed(level, row, child)
                    got = cells[at + row * self.width + cell] * sign
                    est.append(got if own else size - got)
            count = np.clip(np.rint((np.median(est[0::2], axis=0) + np.median(est[1::2], axis=0)) / 2), 0, size)
            right = rest > count
            rest, node, size = np.where(right, rest - count, rest), left + right, np.where(right, size - count, count)
        return node


def _pack(kind: int, first: np.ndarray, second: np.ndarray) -> bytes:
    """Sorted positions as steps, and their weights, compressed."""
    body = np.diff(first, prepend=0).astype("<u4").tobytes() + second.astype("<i8").tobytes()
    return bytes([kind]) + zlib.compress(body, 1)


def _unpack(blob: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    body = zlib.decompress(blob[1:])
    n = len(body) // 12
    return blob[0], np.cumsum(np.frombuffer(body, "<u4", n).astype(np.int64)), np.frombuffer(body, "<i8", n, 4 * n)


class _Sum:
    """The sum of the parts of one group."""

    def __init__(self, shape: Shape):
        self.shape, self.n, self.cells, self.codes, self.weights, self.held = shape, 0, None, [], [], 0

    def add(self, n: int, blob: bytes) -> None:
        self.n += n
        kind, at, weights = _unpack(blob)
        if kind:
            self._dense()[at] += weights
        else:
            self.codes.append(at)
            self.weights.append(weights)
            self.held += len(at)
            if self.held > 16 * PAIRS:
                self._settle()

    def _dense(self) -> np.ndarray:
        if self.cells is None:
            self.cells = np.zeros(self.shape.cells, np.int64)
        return self.cells

    def _settle(self) -> None:
        """Held pairs become one sorted list, or cells if they are too many."""
        if self.held:
            codes, inverse = np.unique(np.concatenate(self.codes), return_inverse=True)
            weights = np.rint(np.bincount(inverse, np.concatenate(self.weights), len(codes))).astype(np.int64)
            self.codes, self.weights, self.held = [codes], [weights], len(codes)
            if len(codes) > PAIRS or self.cells is not None:
                self._dense()
                self.cells += self.shape.fold(codes, weights)
                self.codes, self.weights, self.held = [], [], 0

    def blob(self) -> bytes:
        self._settle()
        if self.cells is None:
            codes, weights = (self.codes[0], self.weights[0]) if self.held else (np.zeros(0, np.int64),) * 2
            return _pack(0, codes, weights)
        at = np.flatnonzero(self.cells)
        return _pack(1, at, self.cells[at])

    def sketch(self) -> np.ndarray:
        self._settle()
        return self.cells if self.cells is not None else self.shape.fold(self.codes[0], self.weights[0]) if self.held else self._dense()


def _parts_of(frame: pd.DataFrame, keys: list[str], shape: Shape) -> pd.DataFrame:
    counted = frame.groupby([*keys, "code"], dropna=False, sort=False)["weight"].sum().reset_index()
    out = []
    for key, g in counted.groupby(keys, dropna=False, sort=False):
        total = _Sum(shape)
        codes = g["code"].to_numpy(np.int64)
        order = np.argsort(codes)
        total.add(int(g["weight"].sum()), _pack(0, codes[order], g["weight"].to_numpy(np.int64)[order]))
        out.append((*(None if pd.isna(k) else k for k in key), total.n, total.blob()))
    return pd.DataFrame(out, columns=[*keys, "n", "sketch"])


def build(rows: DataFrame, keys: list[str], value: str, weight: str | None = None, scale: int = 1000, shape: Shape | None = None) -> DataFrame:
    """keys, n, sketch: the parts of each group, one or more a task; add them with merge.

    Rows with a null value or NaN don't count; infinite values count as the largest. Values are rounded to 1/scale (see the module for very large ones). weight: a column of integers, negative to take rows back; 1 if not given. Null keys are a group.
    """
    shape = shape or Shape()
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    given = rows.select(*keys, shape.encoded(F.col(value), scale).alias("code"), (F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).alias("weight"))
    schema = T.StructType([*(f for f in given.schema.fields if f.name in keys), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= CHUNK_ROWS:
                yield _parts_of(pd.concat(held), keys, shape)
                held, size = [], 0
        if size:
            yield _parts_of(pd.concat(held), keys, shape)

    return given.mapInPandas(parts, schema)


def _streamed(shape: Shape, keys: list[str]):
    """Adds the parts of each group of a partition sorted by keys, holding one group at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for b in batches:
            done = []
            for *key, n, blob in b[[*keys, "n", "sketch"]].itertuples(index=False, name=None):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key != now:
                    if total is not None:
                        done.append((*now, total.n, total.blob()))
                    now, total = key, _Sum(shape)
                total.add(n, blob)
            yield pd.DataFrame(done, columns=[*keys, "n", "sketch"])
        if total is not None:
            yield pd.DataFrame([(*now, total.n, total.blob())], columns=[*keys, "n", "sketch"])

    return run


def merge(parts: DataFrame, keys: list[str], shape: Shape | None = None, salts: int | None = None) -> DataFrame:
    """keys, n, sketch: one row a group. Parts of a hot group are first added in up to `salts` tasks, then together; a task holds one sum at a time."""
    shape = shape or Shape()
    add = _streamed(shape, keys)
    if salts is None or salts > 1:
        salt = F.pmod(F.xxhash64("sketch"), F.lit(salts or int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        parts = parts.withColumn("_salt", salt).repartition(*keys, "_salt").sortWithinPartitions(*keys).drop("_salt").mapInPandas(add, parts.schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(add, parts.schema)


def quantiles(merged: DataFrame, keys: list[str], fractions: list[float], scale: int = 1000, shape: Shape | None = None) -> DataFrame:
    """keys, n, fraction, value: the ceil(fraction * n)-th smallest value of each group with n > 0, within the stated error."""
    shape = shape or Shape()
    schema = T.StructType([*(f for f in merged.schema.fields if f.name in keys), T.StructField("n", T.LongType()), T.StructField("fraction", T.DoubleType()), T.StructField("value", T.DoubleType())])
    asked = np.array(fractions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *key, n, blob in b[[*keys, "n", "sketch"]].itertuples(index=False, name=None):
                if n > 0:
                    total = _Sum(shape)
                    total.add(n, blob)
                    ranks = np.clip(np.ceil(np.round(asked * n, 9)), 1, n)
                    out += [(*(None if pd.isna(k) else k for k in key), n, f, v) for f, v in zip(fractions, shape.decoded(shape.descend(total.sketch(), ranks), scale).tolist(), strict=True)]
            yield pd.DataFrame(out, columns=[*keys, "n", "fraction", "value"])

    return merged.mapInPandas(run, schema)
