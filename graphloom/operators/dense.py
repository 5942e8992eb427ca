"""Work on batches of packed graphs, for what expressions cannot do (eigenvalues, the
fast Walsh-Hadamard transform of large graphs, matrix rank) or do slowly, one lambda call
at a time (walks over the links, matchings).

Each function is a map over Arrow batches. Spark partitions the graphs; nothing is
grouped or shuffled, and a batch is cut so that a stack of matrices stays small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 60
STACK_BYTES = 32 << 20


def _stacks(batch: pa.RecordBatch, bytes_per_cell: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and adjacency stacks (rows, n, n) of one batch, by size; rows whose n
    is NULL are in none."""
    n_all = batch.column(batch.schema.get_field_index("n")).fill_null(-1).to_numpy(zero_copy_only=False)
    words = batch.column(batch.schema.get_field_index("tri"))
    starts = words.offsets.to_numpy()
    flat = words.values.to_numpy(zero_copy_only=False).astype(np.uint64)
    for n in np.unique(n_all[n_all >= 0]):
        rows_n = np.flatnonzero(n_all == n)
        step = max(1, STACK_BYTES // max(1, int(n) * int(n) * bytes_per_cell))
        v, u = np.tril_indices(int(n), -1)
        p = v * (v - 1) // 2 + u
        for at in range(0, len(rows_n), step):
            rows = rows_n[at : at + step]
            stack = np.zeros((len(rows), n, n), dtype=np.float64)
            if len(p):
                word = flat[starts[rows][:, None] + (p // WORD)[None, :]]
                bit = (word >> (WORD - 1 - p % WORD).astype(np.uint64)[None, :]) & np.uint64(1)
                stack[:, u, v] = bit
                stack[:, v, u] = bit
            yield rows, stack


def _chosen(batch: pa.RecordBatch, name: str, rows: np.ndarray, n: int) -> np.ndarray:
    """Which of n vertices the lists of these rows name (rows, n)."""
    lists = batch.column(batch.schema.get_field_index(name)).take(pa.array(rows))
    owner = lists.value_parent_indices().to_numpy()
    mask = np.zeros((len(rows), n), bool)
    mask[owner, lists.flatten().to_numpy()] = True
    return mask


def _map_batches(df: DataFrame, out: list[T.StructField], kernel, cell_bytes: int, given: str | None = None) -> DataFrame:
    """`kernel(stack)`, or `kernel(stack, mask)` for the vertices the lists `given` name,
    gives one array per new column; other columns pass through."""
    schema = T.StructType(df.schema.fields + out)

    def run(batches):
        def number(t):
            return pa.float64() if isinstance(t, T.DoubleType) else pa.int64()

        arrow_types = [pa.list_(number(f.dataType.elementType)) if isinstance(f.dataType, T.ArrayType) else number(f.dataType) for f in out]
        for batch in batches:
            values: list[list] = [[None] * batch.num_rows for _ in out]
            for rows, stack in _stacks(batch, cell_bytes):
                masks = [_chosen(batch, given, rows, stack.shape[1])] if given else []
                for column, result in zip(values, kernel(stack, *masks)):
                    for r, x in zip(rows, result):
                        column[r] = x
            arrays = [pa.array(c, type=t) for c, t in zip(values, arrow_types)]
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + arrays, names=batch.schema.names + [f.name for f in out]
            )

    return df.mapInArrow(run, schema)


SPECTRA = ("lap", "adj", "nlap")


def _spectra(stack: np.ndarray, kinds: tuple[str, ...]):
    n = stack.shape[1]
    if not n:
        return [[None] * len(stack) for _ in kinds]
    degree = stack.sum(axis=2)
    laplacian = -stack.copy()
    laplacian[:, range(n), range(n)] += degree
    scale = np.where(degree > 0, 1.0 / np.sqrt(np.where(degree > 0, degree, 1.0)), 0.0)
    matrix = {"lap": lambda: laplacian, "adj": lambda: stack,
              "nlap": lambda: np.eye(n) - scale[:, :, None] * stack * scale[:, None, :]}
    return [np.linalg.eigvalsh(matrix[k]()) for k in kinds]


def spectra(packed: DataFrame, kinds: tuple[str, ...] = SPECTRA) -> DataFrame:
    """Adds sorted eigenvalues of the Laplacian, the adjacency matrix and the
    normalised Laplacian (isolated vertices scaled by 0): `lap`, `adj`, `nlap`, or
    those of them in `kinds`. Graphs without vertices get NULL."""
    out = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in kinds]
    return _map_batches(packed, out, lambda stack: _spectra(stack, kinds), 8 * 6)


def _weight_sums(stack: np.ndarray):
    """Count, sum, sum of squares and maximum of the weights x|z over the non-zero
    coefficients, by a Walsh-Hadamard transform along i of M[x, i] = A[i, i^x]."""
    b, n, _ = stack.shape
    i = np.arange(n)
    m = stack[:, i[None, :], i[None, :] ^ i[:, None]]
    h = 1
    while h < n:
        m = m.reshape(b, n, n // (2 * h), 2, h)
        m = np.stack((m[..., 0, :] + m[..., 1, :], m[..., 0, :] - m[..., 1, :]), axis=3)
        m = m.reshape(b, n, n)
        h *= 2
    weight = np.bitwise_count((i[:, None] | i[None, :]).astype(np.uint32)).astype(np.int64)
    kept = m != 0
    return (
        kept.sum(axis=(1, 2)),
        (kept * weight).sum(axis=(1, 2)),
        (kept * weight * weight).sum(axis=(1, 2)),
        np.where(kept, weight, 0).max(axis=(1, 2)),
    )


def pauli_sums(packed: DataFrame) -> DataFrame:
    """Adds `terms, w_sum, w_squares, w_max` for graphs of any power-of-two size."""
    out = [T.StructField(c, T.LongType()) for c in ("terms", "w_sum", "w_squares", "w_max")]
    return _map_batches(packed, out, _weight_sums, 8 * 4)


def _walks(stack: np.ndarray):
    """Degrees, twice the triangles at each vertex, components, whether two colours
    suffice, and the diameter. Neighbours and reached vertices are sets of 64-bit words;
    a round lets every vertex take over what its neighbours reach."""
    b, n, _ = stack.shape
    if not n:
        return [[]] * b, [[]] * b, [0] * b, [1] * b, [None] * b
    bits = np.packbits(stack > 0, axis=2, bitorder="little")
    near = np.zeros((b, n, -(-n // 64) * 8), np.uint8)
    near[:, :, : bits.shape[2]] = bits
    near = near.view(np.uint64).reshape(b * n, -1)
    degree = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
    own = np.arange(b * n)
    unit = np.zeros_like(near)  # of each vertex, the set that holds only itself
    unit[own, own % n // 64] = np.uint64(1) << (own % n % 64).astype(np.uint64)
    # Each vertex counts as its own neighbour, so that no vertex is without one.
    g, i, j = np.nonzero(stack + np.eye(n))
    at, to = g * n + i, g * n + j
    starts = np.searchsorted(at, own)
    common = np.bitwise_count(near[at] & near[to]).sum(axis=1, dtype=np.int64)
    corners = np.add.reduceat(common, starts) - degree
    reach, rounds = unit, np.zeros(b, np.int64)
    while True:
        further = np.bitwise_or.reduceat(reach[to], starts, axis=0)
        grown = (further != reach).reshape(b, -1).any(axis=1)
        if not grown.any():
            break
        reach, rounds = further, rounds + grown
    # The lowest vertex of a component stands for it; links between equal distances from
    # it (modulo 2) are odd cycles.
    below = np.zeros_like(unit[:n])
    below[1:] = np.bitwise_or.accumulate(unit[: n - 1], axis=0)
    lowest = ~(reach.reshape(b, n, -1) & below).any(axis=2)
    parts = lowest.sum(axis=1)
    seen, odd = lowest.ravel(), np.zeros(b * n, bool)
    while not seen.all():
        odd ^= ~seen
        seen = np.logical_or.reduceat(seen[to], starts)
    equal = np.zeros(b, bool)
    equal[g[(i != j) & (odd[at] == odd[to])]] = True
    diameter = [int(r) if one else None for r, one in zip(rounds, parts == 1)]
    return degree.reshape(b, n), corners.reshape(b, n), parts, 1 - equal.astype(np.int64), diameter


def walks(packed: DataFrame) -> DataFrame:
    """Adds `deg` and `tri2` (by vertex), `n_components`, `is_bipartite` and `diameter`
    (NULL unless connected), as the expressions of `topology` do."""
    kinds = {"deg": "array<int>", "tri2": "array<bigint>", "n_components": "int", "is_bipartite": "int", "diameter": "int"}
    out = [T.StructField(c, T.ArrayType(T.LongType()) if k.startswith("array") else T.LongType()) for c, k in kinds.items()]
    return _map_batches(packed, out, _walks, 8 * 6).withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


_PRIME = 2_147_483_647


def _inverse(x: np.ndarray) -> np.ndarray:
    """Inverses modulo the prime, by Fermat."""
    result, base, e = np.ones_like(x), x.copy(), _PRIME - 2
    while e:
        if e & 1:
            result = result * base % _PRIME
        base = base * base % _PRIME
        e >>= 1
    return result


def _half_rank(stack: np.ndarray, seed: int) -> np.ndarray:
    """Half the rank of a random skew-symmetric matrix on the links, modulo a prime."""
    b, n, _ = stack.shape
    rng = np.random.default_rng(seed)
    draw = np.triu(rng.integers(1, _PRIME, size=(n, n), dtype=np.int64), 1)
    a = stack.astype(np.int64) * (draw - draw.T) % _PRIME
    rank = np.zeros(b, dtype=np.int64)
    every = np.arange(b)
    for column in range(n):
        below = (np.arange(n)[None, :] >= rank[:, None]) & (a[:, :, column] != 0)
        has = below.any(axis=1)
        pivot = np.where(has, below.argmax(axis=1), 0)
        g, target = every[has], rank[has]
        if not len(g):
            continue
        top, swap = a[g, target].copy(), a[g, pivot[has]].copy()
        a[g, target], a[g, pivot[has]] = swap, top
        row = swap * _inverse(swap[:, column])[:, None] % _PRIME
        factor = np.where(np.arange(n)[None, :] > target[:, None], a[g, :, column], 0)
        a[g] = (a[g] - factor[:, :, None] * row[:, None, :]) % _PRIME
        rank[has] += 1
    return rank // 2


def _numeric_half_rank(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the rank of a random real skew matrix, and whether it is beyond doubt: no
    eigenvalue lies between what rounding makes of zero and what counts as not zero."""
    n = stack.shape[1]
    rng = np.random.default_rng(0)
    draw = np.triu(rng.uniform(0.5, 1.5, size=(n, n)) * rng.choice([-1.0, 1.0], size=(n, n)), 1)
    size = np.abs(np.linalg.eigvalsh(1j * (stack * (draw - draw.T))))
    top = np.maximum(size.max(axis=1, keepdims=True), 1e-300)
    clear = ~((size > 1e-12 * top) & (size < 1e-7 * top)).any(axis=1)
    return (size >= 1e-7 * top).sum(axis=1) // 2, clear


def _matching(stack: np.ndarray):
    """Largest matching as half the rank of a random skew matrix on the links (Lovász).

    Real numbers decide where their eigenvalues leave no doubt. For the rest the rank
    is taken modulo a prime, the best of three draws; a draw can only fall short, with
    chance below n / 2^31."""
    best, clear = _numeric_half_rank(stack)
    for seed in (1, 2, 3):
        open_ = ~clear if seed == 1 else ~clear & (best < stack.shape[1] // 2)
        if open_.any():
            found = _half_rank(stack[open_], seed)
            best[open_] = found if seed == 1 else np.maximum(best[open_], found)
    return (best,)


def _small_matching(stack: np.ndarray):
    """Largest matching, exact, for few vertices: that of every set of the first vertices,
    one vertex more at a time. The next vertex is left alone or joined to one of the set."""
    b, n, _ = stack.shape
    link = np.ascontiguousarray(np.moveaxis(stack, 0, -1), dtype=np.int8)
    best = np.zeros((1, b), np.int8)  # by set, its vertices as bits
    for v in range(n):
        joined = best.copy()
        for u in range(v):
            halves = (-1, 2, 1 << u, b)  # sets without and with u
            out = joined.reshape(halves)[:, 1]
            np.maximum(out, best.reshape(halves)[:, 0] + link[u, v], out=out)
        best = np.concatenate([best, joined])
    return (best[-1].astype(np.int64),)


def large_matching(packed: DataFrame) -> DataFrame:
    """Adds `max_matching_size` for graphs of any size."""
    return _matched(packed, _matching, 8 * 6)


def max_matching(packed: DataFrame, exact_to: int) -> DataFrame:
    """Adds `max_matching_size`: exact up to `exact_to` vertices, matrix rank beyond."""
    # For each graph there are 2^n bytes of sets, twice.
    cells = max(8 * 6, -(-(2 << exact_to) // max(1, exact_to) ** 2))
    return _matched(packed, lambda stack: _small_matching(stack) if stack.shape[1] <= exact_to else _matching(stack), cells)


def _matched(packed: DataFrame, kernel, cell_bytes: int) -> DataFrame:
    done = _map_batches(packed, [T.StructField("max_matching_size", T.LongType())], kernel, cell_bytes)
    return done.withColumn("max_matching_size", F.col("max_matching_size").cast("int"))


def _kernel_support(stack: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of a random skew-symmetric matrix on the links, modulo a prime, and at which
    vertices some vector of its kernel isn't zero. The elimination clears each pivot's
    column above it too, so the kernel can be read from the columns without a pivot."""
    b, n, _ = stack.shape
    rng = np.random.default_rng(seed)
    draw = np.triu(rng.integers(1, _PRIME, size=(n, n), dtype=np.int64), 1)
    a = stack.astype(np.int64) * (draw - draw.T) % _PRIME
    rank, every, rows = np.zeros(b, dtype=np.int64), np.arange(b), np.arange(n)[None, :]
    pivot_of = np.full((b, n), -1)  # of each column, the row that holds its pivot
    for column in range(n):
        open_ = (rows >= rank[:, None]) & (a[:, :, column] != 0)
        g = every[open_.any(axis=1)]
        if not len(g):
            continue
        target, pivot = rank[g], open_[g].argmax(axis=1)
        top, row = a[g, target].copy(), a[g, pivot].copy()
        row = row * _inverse(row[:, column])[:, None] % _PRIME
        a[g, pivot] = top
        a[g, target] = row
        factor = np.where(rows != target[:, None], a[g, :, column], 0)
        a[g] = (a[g] - factor[:, :, None] * row[:, None, :]) % _PRIME
        pivot_of[g, column] = target
        rank[g] += 1
    free = pivot_of < 0
    mixed = ((a != 0) & free[:, None, :]).any(axis=2)  # rows with a free column
    return rank, free | (np.take_along_axis(mixed, np.maximum(pivot_of, 0), 1) & ~free)


def _regular(stack: np.ndarray) -> np.ndarray:
    """Where a random real skew-symmetric matrix on the links surely has an inverse, so that
    a matching takes in all vertices: I - A X is below 1 for a computed X, by far more than
    rounding can move it. The others may have one too."""
    b, n, _ = stack.shape
    sure = np.zeros(b, bool)
    if not n or n % 2:
        return sure
    rng = np.random.default_rng(0)
    draw = np.triu(rng.uniform(0.5, 1.5, size=(n, n)) * rng.choice([-1.0, 1.0], size=(n, n)), 1)
    a = stack * (draw - draw.T)
    some = np.flatnonzero(np.linalg.slogdet(a)[0] != 0)
    a = a[some]
    try:
        x = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return sure

    def norm(m):
        return np.abs(m).sum(axis=2).max(axis=1, initial=0)

    with np.errstate(all="ignore"):  # numbers that overflow prove nothing
        sure[some] = (norm(np.eye(n) - a @ x) < 1e-2) & (norm(a) * norm(x) * n < 1e12)
    return sure


def missing(stack: np.ndarray, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sizes of largest matchings, and the vertices that some of them leave out. Only graphs
    that aren't surely regular are eliminated, which takes far longer."""
    b, n, _ = stack.shape
    rank, free = np.full(b, n), np.zeros((b, n), bool)
    rest = np.flatnonzero(~_regular(stack))
    if len(rest):
        rank[rest], free[rest] = _kernel_support(stack[rest], seed)
    return rank // 2, [np.flatnonzero(x) for x in free]


def missable(packed: DataFrame, seed: int = 1) -> DataFrame:
    """Adds `max_matching_size` and `missable`, the vertices that some largest matching
    leaves out: those where the kernel of the random skew matrix isn't zero. Both hold
    but for a chance below n^2 / 2^31; `matching.certified` tells."""
    out = [T.StructField("max_matching_size", T.LongType()), T.StructField("missable", T.ArrayType(T.LongType()))]

    done = _map_batches(packed, out, lambda stack: missing(stack, seed), 8 * 6)
    return done.withColumns({"max_matching_size": F.col("max_matching_size").cast("int"), "missable": F.col("missable").cast("array<int>")})


def _barrier(stack: np.ndarray, missed: np.ndarray):
    """The neighbours of the vertices missed, without those, and how many components of
    odd size are left without them. A component goes by its lowest vertex."""
    b, n, _ = stack.shape
    if not n:
        return [[]] * b, [0] * b
    near = ((stack @ missed[:, :, None].astype(float))[:, :, 0] > 0) & ~missed
    kept = ~near
    # Each vertex counts as its own neighbour, so that no vertex is without one.
    g, i, j = np.nonzero((stack > 0) & kept[:, :, None] & kept[:, None, :] | np.eye(n, dtype=bool))
    own = np.arange(b * n)
    starts, to, part = np.searchsorted(g * n + i, own), g * n + j, own
    while True:
        low = np.minimum.reduceat(part[to], starts)
        low = low[low]
        if (low == part).all():
            break
        part = low
    sizes = np.bincount(part[kept.ravel()], minlength=b * n)
    return [np.flatnonzero(x) for x in near], (sizes % 2).reshape(b, n).sum(axis=1)


def barriers(df: DataFrame) -> DataFrame:
    """Adds `barrier` (vertices) and `odd_parts` to packed graphs with `missable`."""
    out = [T.StructField("barrier", T.ArrayType(T.LongType())), T.StructField("odd_parts", T.LongType())]
    done = _map_batches(df, out, _barrier, 8 * 6, "missable")
    return done.withColumns({"barrier": F.col("barrier").cast("array<int>"), "odd_parts": F.col("odd_parts").cast("int")})
