"""Whitening of vectors with exact statistics and an exact characteristic polynomial.

Every entry c becomes the integer x = floor(256 c). The fit list is each distinct x-vector once; n is its length and S
its sums. The scatter M = n * sum(x x') - S S' is n^2 times the covariance and a matrix of integers, so everything
up to the eigenvalues is exact:

* tasks sum the products of their rows as integers, Spark adds the sums up;
* M's characteristic polynomial is found modulo primes of 31 bits, one row of a table per prime, by reduction to
  Hessenberg form, and put together by Chinese remainders; the number of primes follows from a bound on the
  coefficients of a positive semidefinite matrix;
* all roots are real, so the roots above a point are as many as the sign changes of the polynomial shifted to
  it; bisection isolates the largest ones, and signs at dyadic points narrow them to 240 bits;
* inverse iteration with M minus the root, in decimals of 120 digits, gives the null space and so the component.
  Roots that agree to 240 bits share a null space, of which the components are an orthonormal basis.

A row's value on a component is (n x - S) . v / sqrt(root): centred before it is multiplied, from integers.

Rows whose vector is null or holds null or non-finite entries are dropped; others come back as often as they stand in
the table, a null vec_id too. Entries whose x is no long take the nearest long. Vectors of each length are
whitened among themselves. A component without variance (fewer distinct vectors than components) has a null
`whitened`, explains 0, and takes no part in `identity_error`; with no variance at all `explained` and
`identity_error` are null. A `deviation` beyond a long is null. Empty tables give an empty table; empty vectors have no
components. Extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from decimal import Decimal, localcontext
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm.frames import stored

COMPONENTS = 4
SCALE = 256
LIMB = 20
CHUNK = 1 << 12
FLUSH = 1 << 10
ROOT_BITS = 240
DIGITS = 120
PRIME_PARTS = 24


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x: the rows whose vector has only finite entries, scaled and floored."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.where(F.col("v").isNotNull() & ~bad).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def blocks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length that occurs."""
    bounds, values = np.asarray(column.offsets), np.asarray(column.values)
    lengths = np.diff(bounds)
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield rows, values[bounds[:-1][rows][:, None] + np.arange(d)[None, :]]


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Parts of less than LIMB bits whose sum, each shifted by LIMB more than the one before, is x."""
    out = []
    while x.size and (x.max() >= 1 << LIMB or x.min() <= -(1 << LIMB)):
        out.append(x & ((1 << LIMB) - 1))
        x = x >> LIMB
    return [*out, x]


def moments(fit: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """Per length of vectors: n, S and the sums of products, all exact. What reaches the driver has the size of the matrix."""

    def partial(batches):
        sums: dict[tuple[int, int], tuple[np.ndarray, int]] = {}

        def rows(key):
            total, _ = sums.pop(key)
            i, j = np.nonzero(total)
            return pa.RecordBatch.from_pydict({
                "d": np.full(len(i), key[0], np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32),
                "shift": np.full(len(i), key[1], np.int32), "value": total[i, j],
            })

        for batch in batches:
            for _, x in blocks(batch.column("x")):
                for start in range(0, len(x), CHUNK):
                    part = x[start: start + CHUNK]
                    one = np.concatenate([part, np.ones((len(part), 1), np.int64)], axis=1)
                    for (a, low), (b, high) in combinations_with_replacement(enumerate(limbs(one)), 2):
                        # sums of at most CHUNK products of two limbs are exact in doubles
                        product = low.T.astype(np.float64) @ high.astype(np.float64)
                        product = product if a == b else product + product.T
                        key = (x.shape[1], LIMB * (a + b))
                        total, n = sums.get(key, (0, 0))
                        sums[key] = (total + product.astype(np.int64), n + 1)
                        if n + 1 == FLUSH:
                            yield rows(key)
        for key in list(sums):
            yield rows(key)

    added = fit.mapInArrow(partial, "d int, i int, j int, shift int, value long").where("i <= j")
    total = added.groupBy("d", "i", "j", "shift").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = {}
    for d, i, j, shift, value in total.toLocalIterator():
        n, s, g = out.setdefault(d, ([0], [0] * d, [[0] * d for _ in range(d)]))
        value = int(value) << shift
        if i == d:
            n[0] += value
        elif j == d:
            s[i] += value
        else:
            g[i][j] += value
            g[j][i] += value if i != j else 0
    return {d: (n[0], s, g) for d, (n, s, g) in out.items() if d}


# --- characteristic polynomial ------------------------------------------------------------------------------


def is_prime(p: int) -> bool:
    """For numbers below 3,215,031,751: no strong liar to the bases 2, 3, 5 and 7."""
    if p < 11 or p % 2 == 0:
        return p in (2, 3, 5, 7)
    odd = p - 1
    twos = (odd & -odd).bit_length() - 1
    odd >>= twos
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x in (1, p - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes of 31 bits whose product is above `bound`."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo p, lowest first, by way of a similar matrix in Hessenberg form."""
    h, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        pivots = np.flatnonzero(h[k + 1:, k])
        if not len(pivots):
            continue
        r = k + 1 + int(pivots[0])
        if r != k + 1:
            h[[k + 1, r]] = h[[r, k + 1]]
            h[:, [k + 1, r]] = h[:, [r, k + 1]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[k + 1][None, :] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor[None, :] % p).sum(axis=1)) % p
    found = np.zeros((d + 1, d + 1), np.int64)
    found[0, 0] = 1
    for k in range(1, d + 1):  # expansion of the leading k by k part along its last column
        row = np.concatenate([[0], found[k - 1, :-1]])
        row = (row - h[k - 1, k - 1] * found[k - 1] % p) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            row = (row - int(h[i - 1, k - 1]) * below % p * found[i - 1] % p) % p
        found[k] = row
    return found[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients of det(x - m), lowest first, for a positive semidefinite matrix of integers."""
    d = len(m)
    mean = -(-sum(m[i][i] for i in range(d)) // d)
    bound = max(math.comb(d, k) * mean**k for k in range(d + 1))  # of sums of products of k roots
    primes = primes_beyond(2 * bound)
    shared = spark.sparkContext.broadcast((np.array(m, object), primes))

    def residues(batches):
        matrix, moduli = shared.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                p = moduli[k]
                found = polynomial_modulo((matrix % p).astype(np.int64), p)
                yield pa.RecordBatch.from_pydict({"id": [k], "residues": pa.array([found], pa.list_(pa.int64()))})

    found = spark.range(0, len(primes), 1, min(len(primes), PRIME_PARTS)).mapInArrow(residues, "id long, residues array<long>")
    product, total = math.prod(primes), [0] * (d + 1)
    for k, values in found.collect():  # a row of d + 1 longs per prime
        others = product // primes[k]
        unit = others * pow(others, -1, primes[k])
        total = [t + unit * v for t, v in zip(total, values)]
    return [t - product if 2 * t > product else t for t in (t % product for t in total)]


# --- roots and null spaces ------------------------------------------------------------------------------------


def roots_above(polynomial: list[int], a: int, s: int) -> int:
    """Roots above a / 2^s, with multiplicity, of a polynomial that has only real roots: the sign changes after a shift."""
    d = len(polynomial) - 1
    c = [x << (s * (d - k)) for k, x in enumerate(polynomial)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign_at(polynomial: list[int], a: int, s: int) -> int:
    d, value = len(polynomial) - 1, polynomial[-1]
    for k in range(d - 1, -1, -1):
        value = value * a + (polynomial[k] << (s * (d - k)))
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], most: int) -> list[tuple[int, int]]:
    """Up to `most` positive roots from the largest, with multiplicity, as (a, s): the root is within (a, a + 1] / 2^s,
    a has more than ROOT_BITS bits. Roots with equal (a, s) agree to that many bits."""
    d = len(polynomial) - 1
    trace = -polynomial[d - 1]
    positive = roots_above(polynomial, 0, 0)
    out: list[tuple[int, int]] = []
    for k in range(1, min(most, positive) + 1):
        low, high, s, above_low, above_high = 0, max(trace, 1), 0, positive, 0
        at_high = None
        while high - low > 1 or low.bit_length() <= ROOT_BITS:
            if high - low == 1:
                low, high, s = 2 * low, 2 * high, s + 1
                continue
            middle = (low + high) // 2
            if above_low - above_high > 1:
                count = roots_above(polynomial, middle, s)
                if count >= k:
                    low, above_low = middle, count
                else:
                    high, above_high = middle, count
                continue
            # one simple root in (low, high]: the sign changes at it
            at_high = (-1) ** above_high if at_high is None else at_high
            here = sign_at(polynomial, middle, s)
            if here == -at_high:
                low = middle
            else:
                high = middle
        out.append((low, s))
    return out


def null_vectors(m: list[list[int]], root: Decimal, count: int) -> list[list[Decimal]]:
    """`count` orthonormal vectors that m - root takes to nearly zero, by inverse iteration."""
    d = len(m)
    a = [[Decimal(x) for x in row] for row in m]
    for i in range(d):
        a[i][i] -= root
    least = max(max(abs(x) for x in row) for row in a) * Decimal(10) ** (10 - DIGITS) or Decimal(1)
    order = list(range(d))
    for k in range(d):  # a becomes its triangular factors, rows in `order`
        r = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[r], order[k], order[r] = a[r], a[k], order[r], order[k]
        if abs(a[k][k]) < least:
            a[k][k] = least
        pivot, tail = a[k][k], a[k][k + 1:]
        for i in range(k + 1, d):
            f = a[i][k] / pivot
            if f:
                a[i][k + 1:] = [x - f * y for x, y in zip(a[i][k + 1:], tail)]
            a[i][k] = f
    dot = lambda x, y: sum((p * q for p, q in zip(x, y)), Decimal(0))

    def unit(x, done):
        for other in done:
            f = dot(x, other)
            x = [p - f * q for p, q in zip(x, other)]
        norm = dot(x, x).sqrt()
        return [p / norm for p in x]

    def solved(b):
        y = [b[i] for i in order]
        for i in range(d):
            y[i] -= dot(a[i][:i], y[:i])
        for i in range(d - 1, -1, -1):
            y[i] = (y[i] - dot(a[i][i + 1:], y[i + 1:])) / a[i][i]
        return y

    rng, found = random.Random(11), []
    for _ in range(count):
        x = unit([Decimal(rng.randrange(1, 1 << 30)) for _ in range(d)], found)
        for _ in range(3):
            x = unit(solved(x), found)
        found.append(x)
    return found


class Model:
    """Components of one fit list: n, S, unit vectors (one a row), square roots of M's eigenvalues, shares of the trace."""

    def __init__(self, spark: SparkSession, n: int, s: list[int], products: list[list[int]], most: int):
        d = len(s)
        self.n, self.sums, self.components = n, s, min(most, d)
        m = [[n * products[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]
        trace = sum(m[i][i] for i in range(d))
        roots = largest_roots(characteristic_polynomial(spark, m), self.components) if trace else []
        vectors, self.spread, self.explained = [], [], []
        with localcontext() as context:
            context.prec = DIGITS
            context.Emax, context.Emin = 999_999_999, -999_999_999
            for a, shift in dict.fromkeys(roots):
                root = (Decimal(2 * a + 1) / 2) / Decimal(2) ** shift
                times = roots.count((a, shift))
                vectors += [[float(x) for x in v] for v in null_vectors(m, root, times)]
                self.spread += [float(root.sqrt())] * times
                self.explained += [float(root / trace)] * times
        self.vectors = np.array(vectors, np.float64).reshape(len(vectors), d)
        self.explained += [0.0 if trace else None] * (self.components - len(roots))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they hold it and its squares' sum, else Python's integers."""
        top = max(abs(int(x.max())), abs(int(x.min())))
        most = self.n * top + max(map(abs, self.sums))
        if most * most * x.shape[1] < 1 << 63:
            return self.n * x - np.array(self.sums, np.int64)[None, :]
        return self.n * x.astype(object) - np.array(self.sums, object)[None, :]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) @ self.vectors.T) / np.array(self.spread)[None, :]


def _identity_errors(fit: DataFrame, models) -> dict[int, float]:
    """Per length, the largest entry of (covariance of the whitened fit list minus the identity), by absolute value."""

    def project(batches):
        for batch in batches:
            for _, x in blocks(batch.column("x")):
                model = models.value.get(x.shape[1])
                if model is not None and len(model.vectors):
                    w = model.whitened(model.centred(x))
                    yield pa.RecordBatch.from_pydict({
                        "d": np.full(len(x), x.shape[1], np.int32), "w": pa.FixedSizeListArray.from_arrays(w.ravel(), w.shape[1]).cast(pa.list_(pa.float64())),
                    })

    width = max((len(m.vectors) for m in models.value.values()), default=0)
    if not width:
        return {}
    pairs = list(combinations_with_replacement(range(width), 2))
    w = fit.mapInArrow(project, "d int, w array<double>")
    errors = [F.abs(F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))) - float(i == j)) for i, j in pairs]
    found = w.groupBy("d").agg(F.array_max(F.array(*errors)).alias("error"))
    return {d: error for d, error in found.collect()}  # one row per length


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    spark = vectors.sparkSession
    rows = integers(vectors)
    fit = stored(rows.select("x").distinct(), "fit")  # copies fold before the shuffle
    fitted = {d: Model(spark, n, s, products, components) for d, (n, s, products) in moments(fit).items()}
    models = spark.sparkContext.broadcast(fitted)
    errors = _identity_errors(fit, models)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            for place, x in blocks(batch.column("x")):
                if not x.shape[1]:
                    continue
                model = models.value[x.shape[1]]
                k, centred = model.components, model.centred(x)
                deviation = (centred * centred).sum(axis=1)
                deviation = [v if v < 1 << 63 else None for v in deviation.tolist()]
                own = model.whitened(centred) if len(model.vectors) else np.zeros((len(x), 0))
                missing = np.zeros((len(x), k), bool)
                missing[:, own.shape[1]:] = True
                full = np.concatenate([own, np.zeros((len(x), k - own.shape[1]))], axis=1)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(place, k))),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": np.full(len(x) * k, model.n, np.int64),
                    "deviation": pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    "whitened": pa.array(full.ravel(), pa.float64(), mask=missing.ravel()),
                    "explained": pa.array(model.explained * len(x), pa.float64()),
                    "identity_error": pa.array([errors.get(x.shape[1])] * (len(x) * k), pa.float64()),
                })

    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(apply, schema)
