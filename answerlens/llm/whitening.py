"""Whitening of embeddings through an incremental eigendecomposition, refined on the whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from answerlens.operators.scale import materialize

COMPONENTS = 8
#: An entry c is coded as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries from here on have no code in range; their vectors are left out like non-finite ones.
TOO_LARGE = 2.0**38
#: Rows whose triangular factor is folded into a spectrum at a time, each row of the factor as one rank-one update.
BLOCK = 1_024
#: States that one task of the reduction tree combines.
FAN = 8
#: Eigenvalues below this share of the trace have no direction to speak of.
FLAT = 1e-13
_EPS = np.finfo(float).eps


def secular_roots(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z^2 / (poles - x)) for ascending distinct poles and z without zeros.

    Returned as the pole next to each root and the distance from it, which keeps the small differences exact.  All roots
    are sought at once by rational steps through both neighbouring poles, inside brackets that always halve.
    """
    k = len(poles)
    square = z * z
    top = np.append(poles[1:], poles[-1] + square.sum())
    middle = (poles + top) / 2
    at_middle = 1 + (square / (poles - middle[:, None])).sum(1)
    near = np.arange(k)
    right = at_middle < 0  # the root lies in the upper half
    right[-1] = False
    near[right] += 1
    origin = poles[near]
    gaps = poles - origin[:, None]  # row: root, column: pole
    low, high = poles - origin, top - origin
    half = middle - origin
    low, high = np.where(at_middle < 0, half, low), np.where(at_middle < 0, high, half)
    x = (low + high) / 2
    upto = np.tri(k, dtype=bool)
    ahead = np.append(poles[1:], np.inf) - origin
    behind = poles - origin
    for _ in range(120):
        away = gaps - x[:, None]
        term = square / away
        value = 1 + term.sum(1)
        done = (np.abs(value) <= 8 * _EPS * (1 + np.abs(term).sum(1))) | (high - low <= 2 * _EPS * np.abs(x))
        if done.all():
            break
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        slope = term / away
        lower, upper = (slope * upto).sum(1), (slope * ~upto).sum(1)
        d1, d2 = behind - x, np.where(np.isinf(ahead), 1.0, ahead - x)
        last = np.isinf(ahead)
        a = np.where(last, value - d1 * lower, (d1 + d2) * value - d1 * d2 * (lower + upper))
        b = d1 * d2 * value
        c = value - d1 * lower - d2 * upper
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # The last root has one pole beside it: value = r + s / (d1 - move) has its zero at d1 + s / r.
            move = np.where(last, d1 + lower * d1 * d1 / a, move)
        new = x + move
        inside = np.isfinite(new) & (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors after adding v v' to the matrix they belong to.

    In the old basis this is a diagonal plus one outer product.  Directions that v does not touch, and all but one of
    several with equal eigenvalues, are deflated; the others solve the secular equation, and their vectors
    come from the z that has exactly these roots, so they stay orthogonal.
    """
    z = vectors.T @ v
    scale = max(float(np.abs(values).max(initial=0.0)), float(z @ z))
    if not scale:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    tiny = 8 * _EPS * scale
    live: list[int] = []
    size = np.sqrt(z @ z)
    for k in np.flatnonzero(np.abs(z) * size > tiny):
        if live:
            j = live[-1]
            r = np.hypot(z[j], z[k])
            c, s = z[k] / r, z[j] / r
            if (values[k] - values[j]) * abs(c * s) <= tiny:  # turn the pair so that the first is not touched
                first, second = c * vectors[:, j] - s * vectors[:, k], s * vectors[:, j] + c * vectors[:, k]
                vectors[:, j], vectors[:, k] = first, second
                values[j], values[k] = c * c * values[j] + s * s * values[k], s * s * values[j] + c * c * values[k]
                z[j], z[k] = 0.0, r
                live.pop()
        live.append(int(k))
    if live:
        poles, old = values[live], z[live]
        near, x = secular_roots(poles, old)
        gaps = poles[near][:, None] - poles + x[:, None]  # root - pole
        between = poles - poles[:, None]
        np.fill_diagonal(between, 1.0)
        ratio = gaps / between.T
        exact = np.sqrt(np.maximum(ratio.prod(0), 0.0))
        turn = np.copysign(exact, old)[:, None] / -gaps.T
        turn /= np.sqrt((turn * turn).sum(0))
        vectors[:, live] = vectors[:, live] @ turn
        values[live] = poles[near] + x
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, mean, sums and eigendecomposition of the scatter of the rows seen so far."""

    def __init__(self, dim: int):
        self.n, self.sums, self.mean = 0, np.zeros(dim, object), np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def _fold(self, rows: np.ndarray) -> None:
        for v in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, v)

    def _meet(self, n: int, mean: np.ndarray, sums: np.ndarray) -> None:
        """The rank-one update between two means, then the counts of both."""
        if self.n and n:
            self._fold(((mean - self.mean) * np.sqrt(self.n / (self.n + n) * n))[None])
        self.n, self.sums = self.n + n, self.sums + sums
        self.mean = (self.sums / max(self.n, 1)).astype(float)

    def add(self, x: np.ndarray, block: int = BLOCK) -> None:
        """Take in rows of integers, centred within each block; a block of one row is one centred rank-one update."""
        for k in range(0, len(x), block):
            part = x[k:k + block]
            mean = part.mean(0)
            if len(part) > 1:
                self._fold(np.linalg.qr(part - mean, mode="r"))
            self._meet(len(part), mean, part.sum(0).astype(object))

    def merge(self, other: Spectrum) -> None:
        """Take in another spectrum: each of its directions is a rank-one update, and so is the way between the means."""
        self._fold((other.vectors * np.sqrt(np.maximum(other.values, 0.0))).T)
        self._meet(other.n, other.mean, other.sums)

    def to_row(self, slot: int) -> dict:
        return {
            "slot": slot, "n": self.n, "sums": ",".join(map(str, self.sums)),
            "spectrum": np.concatenate((self.values, self.vectors.ravel())).tobytes(),
        }

    @classmethod
    def from_row(cls, n: int, sums: str, spectrum: bytes) -> Spectrum:
        exact = np.array([int(s) for s in sums.split(",")], object)
        out = cls(len(exact))
        flat = np.frombuffer(spectrum)
        out.n, out.sums = int(n), exact
        out.mean = (exact / max(out.n, 1)).astype(float)
        out.values, out.vectors = flat[:len(exact)].copy(), flat[len(exact):].reshape(len(exact), -1).copy()
        return out


_STATE = "slot long, n long, sums string, spectrum binary"
_SUMS = "slot long, sums binary"


def coded(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that remain, and their entries as integers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fits)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    with np.errstate(invalid="ignore"):
        good = (np.abs(flat) < TOO_LARGE).all(1)  # not so for null (NaN) or infinite entries
    return rows[good], np.floor(SCALE * flat[good]).astype(np.int64) + SHIFT


def _spectra(dim: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, waiting, size = Spectrum(dim), [], 0
        for batch in batches:
            x = coded(batch.column(0), dim)[1]
            waiting.append(x)
            size += len(x)
            if size >= block:
                state.add(np.concatenate(waiting), block)
                waiting, size = [], 0
        if size:
            state.add(np.concatenate(waiting), block)
        if state.n:
            yield pa.RecordBatch.from_pylist([state.to_row(TaskContext.get().partitionId())], _STATE_SCHEMA)

    return run


_STATE_SCHEMA = pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("sums", pa.string()), ("spectrum", pa.binary())])


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    rows = frame.sort_values("slot").itertuples(index=False)
    first = next(rows)
    state = Spectrum.from_row(first.n, first.sums, first.spectrum)
    for r in rows:
        state.merge(Spectrum.from_row(r.n, r.sums, r.spectrum))
    return pd.DataFrame([state.to_row(int(first.slot) // FAN)])


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    rows = frame.sort_values("slot")
    total = np.sum([np.frombuffer(x) for x in rows["sums"]], axis=0)
    return pd.DataFrame([{"slot": int(rows["slot"].iloc[0]) // FAN, "sums": total.tobytes()}])


def _reduced(states: DataFrame, combine, schema: str):
    """The one row that a tree of ``combine`` leaves, or None; a task meets FAN states, in the order of their slots."""
    states = materialize(states)
    top = states.agg(F.max("slot")).first()[0]
    while top:
        states = states.groupBy(F.floor(F.col("slot") / FAN)).applyInPandas(combine, schema)
        top //= FAN
    return states.first()


def _sums(of):
    """Sums of ``of(rows)`` over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(of(batch) for batch in batches)
        if np.any(total):
            row = {"slot": TaskContext.get().partitionId(), "sums": total.tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("slot", pa.int64()), ("sums", pa.binary())]))

    return run


class Whitening:
    """What was fitted: number and sums of the vectors, components (rows), eigenvalues, and the trace."""

    def __init__(self, n: int, sums: np.ndarray, components: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.values, self.trace = n, sums, components, values, trace
        self.mean = (sums / max(n, 1)).astype(float)
        self.identity_error = float("nan")

    def project(self, x: np.ndarray) -> np.ndarray:
        flat = self.values <= FLAT * self.trace
        out = ((x - self.mean) @ self.components.T) / np.sqrt(np.where(flat, 1.0, self.values))
        out[:, flat] = 0.0
        return out

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2, exact; null beyond a long."""
        if not len(x):
            return []
        largest = max(abs(self.n * int(x.max()) - min(self.sums)), abs(self.n * int(x.min()) - max(self.sums)))
        if largest * largest * x.shape[1] < 1 << 62:
            apart = self.n * x - self.sums.astype(np.int64)
            return (apart * apart).sum(1).tolist()
        apart = self.n * x.astype(object) - self.sums
        return [int(s) if s < 1 << 63 else None for s in (apart * apart).sum(1)]


def _length(vectors: DataFrame, column: str) -> int | None:
    """Length of the vectors that the fit list is made of: the most frequent one, of equally frequent ones the longer."""
    v = F.col(column)
    whole = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= TOO_LARGE))
    sizes = vectors.filter(v.isNotNull() & (F.size(v) > 0) & whole).groupBy(F.size(v).alias("size")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return first and first[0]


def fit(vectors: DataFrame, vector_column: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """Components of all vectors by an incremental eigendecomposition; None for an empty fit list.

    1. Each task folds its vectors into an eigendecomposition of their scatter.  Blocks of rows are centred and reduced to their
       triangular factor; every row of it, and the shift of the mean, is a rank-one update through the secular equation.
    2. The spectra of the tasks meet in a tree; a spectrum joins another by one rank-one update per direction.
    3. Rayleigh-Ritz: all vectors are projected on that basis, the covariance there is summed over the table in a tree,
       and its eigenvectors turn the basis into the components to double precision.
    A state has dim * (dim + 1) doubles, and a task holds FAN + 1 of them at most.
    """
    dim = _length(vectors, vector_column)
    if dim is None:
        return None
    used = vectors.select(vector_column)
    row = _reduced(used.mapInArrow(_spectra(dim, block), _STATE), _merged, _STATE)
    state = Spectrum.from_row(row.n, row.sums, bytes(row.spectrum))
    basis, mean = np.linalg.qr(state.vectors)[0], state.mean

    def scatter(batch: pa.RecordBatch) -> np.ndarray:
        y = (coded(batch.column(0), dim)[1] - mean) @ basis
        return y.T @ y

    found = _reduced(used.mapInArrow(_sums(scatter), _SUMS), _added, _SUMS)
    inner = np.frombuffer(bytes(found.sums)).reshape(dim, dim) / state.n if found else np.zeros((dim, dim))
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    rows = (basis @ turn[:, order]).T
    rows *= np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])[:, None]  # the largest entry is positive
    return Whitening(state.n, state.sums, rows, np.maximum(values[order], 0.0), float(np.trace(inner)))


def identity_error(vectors: DataFrame, model: Whitening, vector_column: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on the table.

    Components without variance are left out of it.
    """
    dim, k = model.components.shape[1], len(model.values)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = model.project(coded(batch.column(0), dim)[1])
        return np.vstack((w.sum(0), w.T @ w))

    found = _reduced(vectors.select(vector_column).mapInArrow(_sums(moments), _SUMS), _added, _SUMS)
    live = model.values > FLAT * model.trace
    if not found or not live.any():
        return 0.0
    total = np.frombuffer(bytes(found.sums)).reshape(k + 1, k) / model.n
    covariance = total[1:] - np.outer(total[0], total[0])
    return float(np.abs((covariance - np.eye(k))[live][:, live]).max())


def _whitened(model: Whitening):
    dim, k = model.components.shape[1], len(model.values)
    explained = model.values / model.trace if model.trace else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = coded(batch.column(1), dim)
            w = model.project(x)
            count = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(count), k))),
                    pa.array(w.ravel()), pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * k, model.identity_error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS,
) -> DataFrame:
    """Per vector and component: n, deviation, whitened coordinate, explained share, and the measured identity_error.

    Vectors that are null or empty, hold null or non-finite entries (or some of 2^38 and more, which have no code), or
    have another length than most are left out of the fit and of the result.  Components are numbered by falling
    eigenvalue, at most as many as there are dimensions; one without variance has whitened 0.  Repeated rows count and come
    back each for itself, null ids pass through, an empty table gives no rows, further columns are ignored.
    A deviation beyond a long is null.
    """
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, vector_column, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    model.identity_error = identity_error(vectors, model, vector_column)
    found = vectors.select(id_column, vector_column).mapInArrow(_whitened(model), schema)
    return found.withColumnRenamed("id", id_column)
