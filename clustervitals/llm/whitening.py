"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

1. Scatter.  Components become whole numbers x; tasks add up their products exactly, and the sums of all tasks
   give M = n * sum(x x') - S S', which is n * n times the covariance V.
2. Polynomial.  M is brought to Hessenberg form modulo many primes, one task for some of them; each gives the
   characteristic polynomial modulo its prime, and Chinese remaindering gives it over the integers.
3. Roots.  All roots are real and none is negative, so the sign changes of the polynomial shifted to t count the
   roots beyond t exactly.  Halving isolates the largest ones, signs at the middle narrow them down, all in integers.
4. Components.  Inverse iteration on M - root in decimals of as many digits as the roots' distances ask for.
5. Vectors are projected, and the covariance of what comes out is compared with the identity.

Only sums over dimensions (d (d + 1) / 2 numbers) and the polynomials reach the driver, whatever the rows.
Vectors of different length are whitened apart, each length among its own.
"""

from __future__ import annotations

import decimal
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import keep

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
# Numbers are cut into parts of so many bits; products of two, summed over a block of rows, fit a double exactly.
_PART_BITS, _BLOCK_ROWS = 20, 8192
# Sums travel as four longs of 40 bits, the last one with the sign.
_LIMB_BITS, _LIMBS = 40, 4
# Roots that agree to so many bits are one of several dimensions; others are narrowed by so many bits, and until
# half as many part them from the next.
_SAME_BITS, _NARROW_BITS = 256, 128


def whole(vector: str, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each component c as double.

    Null if the vector or a component is null or not finite, or if a component's whole number would pass 2^62.
    """
    column = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double") * scale)
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 62)))
    return F.when(~bad, F.transform(column, lambda c: F.floor(c).cast("long") + offset))


# ---- scatter


def _matrices(batch: pa.RecordBatch, offset: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, places, numbers less the offset) of the vectors of each length."""
    lists = batch.column("x")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        for at in range(0, len(rows), _BLOCK_ROWS):
            some = rows[at : at + _BLOCK_ROWS]
            yield dim, some, flat[(ends[some] - dim)[:, None] + np.arange(dim)] - offset


def _parts(y: np.ndarray) -> list[np.ndarray]:
    """Signed parts of ``_PART_BITS`` bits, smallest first, as doubles."""
    out, half = [], 1 << (_PART_BITS - 1)
    while True:
        low = ((y + half) & ((1 << _PART_BITS) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> _PART_BITS
        if not y.any():
            return out


def exact_products(y: np.ndarray) -> np.ndarray:
    """The sum of y y' over the rows, as Python integers."""
    total: np.ndarray | int = 0
    parts = _parts(y)
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            total = total + ((left.T @ right).astype(np.int64).astype(object) << (_PART_BITS * (a + b)))
    return total


def _limbs(value: int) -> list[int]:
    mask = (1 << _LIMB_BITS) - 1
    return [(value >> (_LIMB_BITS * k)) & mask for k in range(_LIMBS - 1)] + [value >> (_LIMB_BITS * (_LIMBS - 1))]


@dataclass
class Scatter:
    """Exact sums over the ``n`` vectors of one length, of the numbers less the offset."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    products: list[list[int]] = field(default_factory=list)

    def matrix(self) -> list[list[int]]:
        """n * n times the covariance."""
        d = range(len(self.sums))
        return [[self.n * self.products[i][j] - self.sums[i] * self.sums[j] for j in d] for i in d]


def scatter(vectors: DataFrame, offset: int = OFFSET) -> dict[int, Scatter]:
    """The sums of the vectors ``x``, per length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, _, y in _matrices(batch, offset):
                # Columns of a block add up to less than 2^13 * 2^62; halves keep the sums in a long.
                sums = (y >> 32).sum(axis=0).astype(object) * (1 << 32) + (y & 0xFFFFFFFF).sum(axis=0).astype(object)
                n, s, p = held.get(dim, (0, 0, 0))
                held[dim] = [n + len(y), s + sums, p + exact_products(y)]
        rows = []
        for dim, (n, s, p) in held.items():
            rows.append((dim, -1, -1, *_limbs(n)))
            rows += [(dim, i, -1, *_limbs(int(s[i]))) for i in range(dim)]
            rows += [(dim, i, j, *_limbs(int(p[i, j]))) for i in range(dim) for j in range(i, dim)]
        columns = list(zip(*rows)) or [()] * (3 + _LIMBS)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    limbs = [f"limb{k}" for k in range(_LIMBS)]
    names = ["dim", "i", "j", *limbs]
    found = vectors.select("x").mapInArrow(work, ", ".join(f"{c} long" for c in names))
    out: dict[int, Scatter] = {}
    for row in found.groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in limbs]).collect():
        value = sum(row[c] << (_LIMB_BITS * k) for k, c in enumerate(limbs))
        s = out.setdefault(row.dim, Scatter(0, [0] * row.dim, [[0] * row.dim for _ in range(row.dim)]))
        if row.i < 0:
            s.n = value
        elif row.j < 0:
            s.sums[row.i] = value
        else:
            s.products[row.i][row.j] = s.products[row.j][row.i] = value
    return out


# ---- characteristic polynomial


def _is_prime(n: int) -> bool:
    """Right for all n below 2^32."""
    for p in (2, 7, 61):
        if n % p == 0:
            return n == p
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        x = pow(p, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return n > 1


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, largest first, until their product passes ``bound``."""
    out, product, p = [], 1, 1 << 31
    while product <= bound:
        p -= 1
        if _is_prime(p):
            out.append(p)
            product *= p
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """det(x - matrix) modulo the prime p < 2^31, lowest power first, through Hessenberg form."""
    h = matrix.copy()
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1]) + k
        if not len(below):
            continue
        if (pivot := below[0]) != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        # The inverse step on the columns; every product is reduced before they are added up.
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(d):
        weights, run = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * run % p
            run = run * int(h[i, i - 1]) % p if i else 0
        shifted = np.append(0, poly[k, :-1])
        poly[k + 1] = (shifted - (weights[:, None] * poly[: k + 1] % p).sum(axis=0)) % p
    return poly[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """det(x - matrix) of a symmetric matrix without negative eigenvalues, lowest power first, exactly."""
    d = len(matrix)
    # The coefficients are sums of products of eigenvalues, at most (1 + mean eigenvalue)^d.
    bound = (1 + -(-sum(matrix[i][i] for i in range(d)) // d)) ** d
    primes = primes_beyond(2 * bound)
    shared = spark.sparkContext.broadcast(matrix)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_matrix = np.array(shared.value, object)
        for batch in batches:
            chosen = batch.column("prime").to_pylist()
            found = [polynomial_modulo((whole_matrix % p).astype(np.int64), p) for p in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names)

    names = ["prime", "found"]
    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks, "prime")
    product = math.prod(primes)
    poly = [0] * (d + 1)
    for row in dealt.mapInArrow(work, "prime long, found array<long>").collect():
        rest = product // row.prime
        factor = rest * pow(rest, -1, row.prime)
        poly = [c + r * factor for c, r in zip(poly, row.found)]
    return [c % product - (product if 2 * (c % product) > product else 0) for c in poly]


# ---- roots


def _shifted(poly: list[int], t: int, bits: int) -> list[int]:
    """Coefficients, up to a power of two, of the polynomial in x / 2^bits moved by t / 2^bits."""
    d = len(poly) - 1
    c = [a << (bits * (d - k)) for k, a in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += t * c[k + 1]
    return c


def roots_beyond(poly: list[int], t: int, bits: int = 0) -> int:
    """How many roots, repeated ones counted each, are larger than t / 2^bits; all roots must be real."""
    signs = [c > 0 for c in _shifted(poly, t, bits) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], t: int, bits: int) -> int:
    value, power = 0, 0
    for a in reversed(poly):
        value = value * t + (a << power)
        power += bits
    return (value > 0) - (value < 0)


@dataclass
class Root:
    """A root in (low, high] / 2^bits; ``count`` of them if they agree to ``_SAME_BITS`` bits."""

    low: int
    high: int
    bits: int
    count: int

    def value(self) -> Fraction:
        return Fraction(self.low + self.high, 2 << self.bits)

    def width(self) -> Fraction:
        return Fraction(self.high - self.low, 1 << self.bits)

    def near(self, smaller: Root) -> bool:
        """Whether the distance is not yet large beside both widths."""
        distance = Fraction(self.low, 1 << self.bits) - Fraction(smaller.high, 1 << smaller.bits)
        return distance < max(self.width(), smaller.width()) * (1 << _NARROW_BITS // 2)

    def halve(self, poly: list[int]) -> None:
        """Halve the interval of a single root; one that is known exactly or stands for several stays."""
        if self.count > 1 or self.low == self.high:
            return
        self.low, self.high, self.bits = 2 * self.low, 2 * self.high, self.bits + 1
        middle, right = (self.low + self.high) // 2, _sign(poly, self.high, self.bits)
        sign = _sign(poly, middle, self.bits) if right else 0
        if not sign:
            self.low = self.high = middle if right else self.high
        elif sign == right:
            self.high = middle
        else:
            self.low = middle


def largest_roots(poly: list[int], k: int) -> list[Root]:
    """The positive roots from the largest on, until there are ``k``, of a polynomial with real roots none negative.

    They are narrowed to ``_NARROW_BITS`` bits, and further until their distance to the next root is known as well.
    """
    inside = roots_beyond(poly, 0)
    if not inside:
        return []
    top = 1
    while roots_beyond(poly, top):
        top <<= 4
    found: list[Root] = []
    work = [(0, top, 0, inside, 0)]  # an interval, its bits, the roots beyond its ends
    while work and sum(r.count for r in found) <= k:  # one more, for its distance
        low, high, bits, beyond_low, beyond_high = work.pop()
        inside = beyond_low - beyond_high
        if inside == 1 or inside and (high - low) << _SAME_BITS < high:
            found.append(Root(low, high, bits, inside))
            for _ in range(_NARROW_BITS if inside == 1 else 0):
                found[-1].halve(poly)
        elif inside:
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            beyond = roots_beyond(poly, middle, bits)
            work += [(low, middle, bits, beyond_low, beyond), (middle, high, bits, beyond, beyond_high)]
    for larger, smaller in zip(found, found[1:]):
        while larger.near(smaller):
            before = larger.width(), smaller.width()
            larger.halve(poly)
            smaller.halve(poly)
            if (larger.width(), smaller.width()) == before:
                break
    out = []
    while found and sum(r.count for r in out) < k:
        out.append(found.pop(0))
    return out


# ---- components


def null_vectors(matrix: list[list[int]], root: Fraction, count: int, digits: int) -> list[list[float]]:
    """``count`` orthonormal vectors that matrix - root takes nearest to zero, by inverse iteration in decimals."""
    with decimal.localcontext() as context:
        context.prec = digits
        context.Emax, context.Emin = decimal.MAX_EMAX, decimal.MIN_EMIN
        d = len(matrix)
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        a = [[Decimal(x) for x in row] for row in matrix]
        for i in range(d):
            a[i][i] -= shift
        tiny = max((abs(x) for row in a for x in row), default=Decimal(0)).scaleb(-digits) or Decimal(1)
        order = list(range(d))
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[pivot] = a[pivot], a[k]
            order[k], order[pivot] = order[pivot], order[k]
            if not a[k][k]:
                a[k][k] = tiny
            row, head = a[k], a[k][k]
            for i in range(k + 1, d):
                other = a[i]
                factor = other[k] / head
                if factor:
                    for j in range(k + 1, d):
                        other[j] -= factor * row[j]
                other[k] = factor

        def solved(b: list[Decimal]) -> list[Decimal]:
            x = [b[i] for i in order]
            for i in range(d):
                x[i] -= sum((a[i][j] * x[j] for j in range(i)), Decimal(0))
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - sum((a[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
            return x

        def unit(v: list[Decimal]) -> list[Decimal]:
            for u in found:
                along = sum(p * q for p, q in zip(u, v))
                v = [q - along * p for p, q in zip(u, v)]
            size = sum(q * q for q in v).sqrt()
            return [q / size for q in v]

        rng, found = random.Random(0), []
        for _ in range(count):
            v = unit([Decimal(rng.randint(1, 1 << 30)) for _ in range(d)])
            for _ in range(4):
                v = unit(solved(v))
            # Either sign is right; the largest entry is made positive so that runs agree.
            found.append([-q for q in v] if max(v, key=abs) < 0 else v)
        return [[float(q) for q in v] for v in found]


@dataclass
class Model:
    """What whitening needs for the vectors of one length; one row, root and share of the trace per component."""

    n: int
    sums: list[int]
    axes: np.ndarray
    roots: np.ndarray
    explained: list[float]
    identity_error: float = 0.0


def fit(vectors: DataFrame, components: int = COMPONENTS, offset: int = OFFSET) -> dict[int, Model]:
    """A model per length of the vectors ``x``; lengths whose vectors are all equal have none."""
    spark = vectors.sparkSession
    models = {}
    for dim, sums in scatter(vectors, offset).items():
        matrix = sums.matrix()
        trace = sum(matrix[i][i] for i in range(dim))
        if not trace:
            continue
        roots = largest_roots(characteristic_polynomial(spark, matrix), components)
        axes = _axes(spark, matrix, roots)[:components]
        values = [r.value() for r in roots for _ in range(r.count)][:components]
        models[dim] = Model(
            sums.n, sums.sums, np.array(axes), np.sqrt([float(v) for v in values]), [float(v / trace) for v in values]
        )
    return models


def _axes(spark: SparkSession, matrix: list[list[int]], roots: list[Root]) -> list[list[float]]:
    """The components of the roots in order, each root in a task."""
    shared = spark.sparkContext.broadcast((matrix, roots))
    names = ["number", "axis", "place"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_matrix, all_roots = shared.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                root = all_roots[k]
                # Digits enough for the interval's width against the largest number in the matrix, and as many again.
                largest = max(abs(x) for row in whole_matrix for x in row).bit_length()
                digits = 2 * int(0.302 * (largest + root.bits)) + 60
                axes = null_vectors(whole_matrix, root.value(), root.count, digits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(axes)), pa.array(axes, pa.list_(pa.float64())), pa.array(range(len(axes)), pa.int64())], names
                )

    dealt = spark.range(len(roots)).repartition(max(1, len(roots)), "id")
    found = dealt.mapInArrow(work, "number long, axis array<double>, place long").collect()
    return [list(r.axis) for r in sorted(found, key=lambda r: (r.number, r.place))]


# ---- projection


def _centred(y: np.ndarray, model: Model) -> np.ndarray:
    """n * x - S, as longs or, where they do not fit, Python integers."""
    largest = max(int(y.max(initial=0)), -int(y.min(initial=0)), 1) * model.n + max(map(abs, model.sums))
    if largest.bit_length() < 63:
        return y * model.n - np.array(model.sums, np.int64)
    return y.astype(object) * model.n - np.array(model.sums, object)


def _projected(centred: np.ndarray, model: Model) -> np.ndarray:
    # n * x - S over the root of n * n * e is x - S / n over that of e.
    return centred.astype(np.float64) @ model.axes.T / model.roots


def _deviations(centred: np.ndarray) -> pa.Array:
    """The sum of squares per row, exactly; null beyond 38 digits."""
    largest = max(abs(int(centred.max())), abs(int(centred.min())))
    if centred.dtype != object and (largest * largest * centred.shape[1]).bit_length() < 64:
        return pa.array((centred * centred).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    sums = (centred.astype(object) ** 2).sum(axis=1).tolist()
    return pa.array([Decimal(v) if v < 10**38 else None for v in sums], pa.decimal128(38, 0))


def _identity_errors(vectors: DataFrame, models: dict[int, Model], offset: int) -> dict[int, float]:
    """The largest absolute entry of the projections' covariance less the identity, per length.

    Tasks centre on their own means; what means differ is added when their sums meet.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for dim, _, y in _matrices(batch, offset):
                if dim not in shared.value:
                    continue
                z = _projected(_centred(y, shared.value[dim]), shared.value[dim])
                mean = z.mean(axis=0)
                own = len(z), mean, (z - mean).T @ (z - mean)
                held[dim] = _met(held[dim], own) if dim in held else own
        columns = [list(held), *(list(c) for c in zip(*((n, m.tolist(), c.ravel().tolist()) for n, m, c in held.values())))]
        columns += [[]] * (4 - len(columns))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["dim", "n", "mean", "products"])

    parts = keep(vectors.select("x").mapInArrow(work, "dim long, n long, mean array<double>, products array<double>"))
    out = {}
    # One row per task and length; a row per length and place is all that comes back.
    means = parts.select("dim", "n", F.posexplode("mean").alias("i", "m")).groupBy("dim", "i").agg(
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean")
    )
    centre = {dim: np.zeros(len(m.roots)) for dim, m in models.items()}
    for r in means.collect():
        centre[r.dim][r.i] = r.mean
    near = {dim: F.array(*[F.lit(float(x)) for x in c]) for dim, c in centre.items()}
    for dim, model in models.items():
        k = len(model.roots)
        apart = F.zip_with("mean", near[dim], lambda a, b: a - b)
        own = parts.filter(F.col("dim") == dim).withColumn("apart", apart)
        sums = own.select(
            "n", "apart", F.posexplode("products").alias("at", "product")
        ).groupBy("at").agg(
            F.sum(
                F.col("product") + F.col("n") * F.get("apart", F.floor(F.col("at") / k).cast("int")) * F.get("apart", F.col("at") % k)
            ).alias("sum")
        )
        found = {r.at: r.sum for r in sums.collect()}
        out[dim] = max(abs(found[i * k + j] / model.n - (i == j)) for i in range(k) for j in range(k))
    return out


def _met(a: tuple, b: tuple) -> tuple:
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def whiten(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """(``key``, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Rows are left out whose vector is null or holds null or non-finite components, or one that takes more than 62
    bits once scaled.  The fit is over all others of the same length, and repeated rows count each.  Components with eigenvalue 0
    cannot be scaled to one and are left out, so equal vectors, a single one and empty ones give no row; equal
    eigenvalues get any orthonormal basis, the same for all rows.  ``deviation`` is a decimal of 38 digits, null beyond.
    """
    vectors = rows.select(F.col(f"`{key}`").alias("id"), whole(vector, scale, offset).alias("x")).filter("x is not null")
    models = fit(vectors, components, offset)
    for dim, error in _identity_errors(vectors, models, offset).items():
        models[dim].identity_error = error
    shared = rows.sparkSession.sparkContext.broadcast(models)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, places, y in _matrices(batch, offset):
                if dim not in shared.value:
                    continue
                model = shared.value[dim]
                centred = _centred(y, model)
                z, k = _projected(centred, model), len(model.roots)
                repeated = pa.array(np.repeat(np.arange(len(y)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(places)).take(repeated),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                        pa.array(np.full(len(y) * k, model.n)),
                        _deviations(centred).take(repeated),
                        pa.array(z.ravel()),
                        pa.array(np.tile(model.explained, len(y))),
                        pa.array(np.full(len(y) * k, model.identity_error)),
                    ],
                    names,
                )

    kind = rows.schema[key].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return vectors.mapInArrow(work, schema).withColumnRenamed("id", key)
