"""Operator 12: vector codes by Yinyang Lloyd.

Vectors become integers and are cut into parts; each part position has a codebook
that Lloyd's rounds refine.  The entries of a codebook are clustered into groups
once.  Every part keeps an upper bound of the distance to its entry and one lower
bound per group; when entries move, the bounds drift with them, and only groups
whose bound no longer clears the upper bound are scanned.  Scans use floating
products; whatever comes near the smallest is settled in integers, so ties and
results are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import small_batches, table
from aerolake.runtime import broadcastable, discard, materialize

#: Parts of a vector, entries of a codebook, rounds, groups of a codebook, units of 1.
PARTS, ENTRIES, ROUNDS, GROUPS, UNIT = 4, 256, 4, 16, 1024
#: Integers stay within this on either side, so that squared distances of up to 256 of them fit 64 bits.
MOST = 1 << 26
ROWS = 4096
STATE = "vec_id long, label {label}, x array<int>, code array<long>, upper array<long>, lower array<long>, scanned long"


def groups_of(entries: np.ndarray, most: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """A group for each entry of a codebook, by a few rounds of plain k-means from evenly spaced entries."""
    n = len(entries)
    k = max(1, min(most, n // 2))
    x = entries.astype(float)
    centres, own = x[np.arange(k) * n // k], np.zeros(n, int)
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
        centres = np.array([x[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(k)])
    return own


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, pair by pair, in integers."""
    d = x.astype(np.int64) - c
    return (d * d).sum(axis=-1)


class Codebook:
    """The entries of one part position, their groups, and how far each has moved since the last round."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray, before: np.ndarray | None = None):
        self.entries, self.groups = entries, groups
        self.members = [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
        self.floats = entries.astype(float)
        self.squares = (self.floats**2).sum(axis=1)
        self.moved = np.zeros(len(entries)) if before is None else np.sqrt(exact(entries, before).astype(float)) * (1 + 1e-12)
        self.drift = np.array([self.moved[m].max(initial=0.0) for m in self.members])

    def scan(self, x: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of x: its nearest of ``members`` (the lowest index of ties), that squared distance, and a lower bound of the second's distance."""
        f = x.astype(float)
        own = (f * f).sum(axis=1)
        far = own[:, None] + self.squares[members][None] - 2 * (f @ self.floats[members].T)
        slack = 1e-9 * (own + self.squares[members].max()) + 1e-9
        best = far.argmin(axis=1)
        least = far[np.arange(len(f)), best]
        close = far <= (least + slack)[:, None]
        square = exact(x, self.entries[members[best]])
        for r in np.flatnonzero(close.sum(axis=1) > 1):
            some = np.flatnonzero(close[r])
            d = exact(x[r], self.entries[members[some]])
            best[r], square[r] = some[d.argmin()], d.min()
        far[np.arange(len(f)), best] = np.inf
        second = np.sqrt(np.maximum(far.min(axis=1) - slack, 0)) if len(members) > 1 else np.full(len(f), np.inf)
        return members[best], square, second

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The new (code, upper, lower) of parts from their last ones, and how many distances each row took; code -1: no bounds yet."""
        n, k = len(x), len(self.members)
        known = code >= 0
        upper = np.where(known, upper + self.moved[code], np.inf)
        lower = np.where(known[:, None], lower - self.drift[None], -1.0)
        took = np.zeros(n, np.int64)
        code = code.copy()
        square = np.zeros(n, np.int64)
        # bounds that do not clear: first the true distance to the own entry, then the groups below it
        at = np.flatnonzero(lower.min(axis=1) <= upper)
        tight = at[known[at]]
        square[tight] = exact(x[tight], self.entries[code[tight]])
        upper[tight] = np.sqrt(square[tight].astype(float)) * (1 + 1e-12)
        took[tight] += 1
        reach = upper.copy()
        best, best_square = code.copy(), np.where(known, square, np.iinfo(np.int64).max)
        for g in range(k):
            rows = at[lower[at, g] <= reach[at]]
            if not len(rows):
                continue
            took[rows] += len(self.members[g])
            found, d, second = self.scan(x[rows], self.members[g])
            nearest = np.sqrt(d.astype(float)) * (1 - 1e-12)
            was, was_square = best[rows], best_square[rows]
            wins = (d < was_square) | ((d == was_square) & ((found < was) | (was < 0)))
            # the group's bound is over its entries but the one that is the part's own
            lower[rows, g] = np.where(wins, second, np.where(found == was, second, nearest))
            out = rows[wins & (was >= 0)]
            left = self.groups[best[out]]
            other = left != g
            lower[out[other], left[other]] = np.minimum(lower[out[other], left[other]], np.sqrt(best_square[out[other]].astype(float)) * (1 - 1e-12))
            best[rows] = np.where(wins, found, was)
            best_square[rows] = np.where(wins, d, was_square)
            reach[rows] = np.minimum(reach[rows], np.sqrt(best_square[rows].astype(float)) * (1 + 1e-12))
        changed = at
        code[changed] = best[changed]
        upper[changed] = np.sqrt(best_square[changed].astype(float)) * (1 + 1e-12)
        return code, upper, lower, took


def integers(vectors: DataFrame, unit: int = UNIT) -> DataFrame:
    """Rows (vec_id, label, x) of all vectors whose components are there and finite, as integers floor(unit * component)."""
    numbers = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.transform(numbers, lambda v: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(v * unit).cast("double"))).cast("int"))
    sound = F.forall(numbers, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False)))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.where(F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), label, whole.alias("x"))


def _lists(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return np.array(column.flatten(), np.int64).reshape(len(column), width)


def _column(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    flat = pa.array(values.astype(np.int64).ravel(), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), flat)


def assigned(state: DataFrame, books: list[Codebook], first: bool) -> DataFrame:
    """A round's assignment of every row; ``first``: rows have no bounds yet."""
    parts, width = len(books), books[0].entries.shape[1]
    sizes = [len(b.members) for b in books]
    edges = np.concatenate(([0], np.cumsum(sizes)))
    shared = state.sparkSession.sparkContext.broadcast([(b.entries, b.groups, b.moved, b.drift) for b in books])  # parts * entries * width numbers

    def of_batches(batches):
        own = []
        for entries, groups, moved, drift in shared.value:
            book = Codebook(entries, groups)
            book.moved, book.drift = moved, drift
            own.append(book)
        for batch in batches:
            n = batch.num_rows
            x = _lists(batch.column(2), parts * width)
            if first:
                code, upper, lower = np.full((n, parts), -1), np.zeros((n, parts)), np.zeros((n, edges[-1]))
                scanned = np.zeros(n, np.int64)
            else:
                code, upper, lower = _lists(batch.column(3), parts), _lists(batch.column(4), parts).astype(float), _lists(batch.column(5), edges[-1]).astype(float)
                scanned = np.asarray(batch.column(6), np.int64).copy()
            for p, book in enumerate(own):
                mine = slice(edges[p], edges[p + 1])
                code[:, p], upper[:, p], lower[:, mine], took = book.assign(x[:, p * width : (p + 1) * width], code[:, p], upper[:, p], lower[:, mine])
                scanned += took
            # whole numbers, upper bounds up and lower ones down: narrow, and still bounds
            high, low = np.ceil(upper), np.floor(np.clip(lower, -1, 2.0**40))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), _column(code), _column(high), _column(low), pa.array(scanned)], ["vec_id", "label", "x", "code", "upper", "lower", "scanned"])

    small_batches(state.sparkSession, ROWS)
    kind = dict(state.dtypes)["label"]
    return state.mapInArrow(of_batches, STATE.format(label=kind))


def moved_entries(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Each entry's parts' componentwise floor(sum / count); entries without parts stay.

    A task sends a row for each part position and entry; as many numbers as the codebooks hold reach the driver.
    """
    parts, k, width = entries.shape

    def of_batches(batches):
        total, count = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            x = _lists(batch.column(0), parts * width).reshape(-1, width)
            at = (_lists(batch.column(1), parts) + np.arange(parts) * k).ravel()
            count += np.bincount(at, minlength=parts * k)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(order) and width:
                total[at[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
        some = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width, pa.int32()), pa.array(total[some].ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(count[some]), sums], ["at", "n", "sums"])

    partial = state.select("x", "code").mapInArrow(of_batches, "at long, n long, sums array<long>")
    added = partial.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(width)])
    out = entries.copy()
    for r in added.collect():
        out[r["at"] // k, r["at"] % k] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS, unit: int = UNIT) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code array, error, scanned) of all sound vectors, and the codebooks (part, entry, position).

    vectors: (vec_id, embedding array, label, any others).  Null vectors and those with null
    or non-finite components are left out.  Vectors whose lengths differ, or are no multiple
    of ``parts``, are filled up with zeros to the longest.  Integers are held within 2^26 on either side.
    The codebooks start as the vectors of smallest vec_id (null last; of equal ids the smaller
    vector first); fewer vectors make smaller codebooks; repeated rows count each; labels may be
    null.  An empty table gives an empty result and codebooks of no entries.  Extra columns are
    ignored.  scanned: distances that a row took over all rounds, of which a plain search takes
    parts * entries * (rounds + 1).
    """
    if "label" in vectors.columns and dict(vectors.dtypes)["label"] == "void":
        vectors = vectors.withColumn("label", F.lit(None).cast("int"))
    rows = integers(vectors, unit)
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    width = -(-(longest or 0) // parts)
    rows = rows.withColumn("x", F.slice(F.concat("x", F.array_repeat(F.lit(0), parts * width)), 1, parts * width) if width else F.col("x"))
    start = [r["x"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]  # as many rows as entries
    kind = dict(rows.dtypes)["label"]
    if not start:
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code array<long>, error long, scanned long"), np.zeros((parts, 0, width), np.int64)
    books = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    grouped = [groups_of(b, groups) for b in books]
    state, before = rows, None
    for r in range(rounds + 1):
        now = [Codebook(b, g, None if before is None else before[p]) for p, (b, g) in enumerate(zip(books, grouped, strict=True))]
        after = materialize(assigned(state, now, first=r == 0), "vector-codes")
        if r:
            discard(state)
        state = after
        if r < rounds:
            before, books = books, moved_entries(state, books)
    return state.select("vec_id", "label", "code", _errors(state, books).alias("error"), "scanned"), books


def _errors(state: DataFrame, books: np.ndarray):
    """Squared distances to the own entries, summed over parts, in integers."""
    parts, _, width = books.shape
    shared = state.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("long")
    def error(x, code):
        own = shared.value
        x, code = np.array(x.tolist(), np.int64).reshape(-1, parts, width), np.array(code.tolist(), np.int64).reshape(-1, parts)
        import pandas as pd

        return pd.Series(sum(exact(x[:, p], own[p][code[:, p]]) for p in range(parts)))

    return error("x", "code")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal integer components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all embeddings."""
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    rows = materialize(coded, "vector-errors")
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if broadcastable(sums, 32) else sums
    text = F.concat_ws("", F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Plain Lloyd in SQL: every part against every entry, round by round."""
    near = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"  # whole numbers far below 2^53
    steps = [
        "kept as (select vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)",
        "parts as materialized (select vec_id, p, v[p * 16 + 1 : p * 16 + 16] as x from kept, range(4) t(p))",
        "first as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < 256)",
        "b0 as materialized (select p, e, x as c from parts join first using (vec_id))",
    ]
    for r in range(5):
        steps.append(f"a{r} as materialized (select vec_id, p, any_value(x) as x, min(d) as d, min_by(e, d * 256 + e) as e from (select vec_id, p, x, e, {near} as d from parts join b{r} using (p)) group by vec_id, p)")
        if r < 4:
            steps.append(f"m{r} as (select p, e, i, floor(sum(v) / count(*)) as v from (select p, e, unnest(x) as v, generate_subscripts(x, 1) as i from a{r}) group by p, e, i)")
            steps.append(f"n{r} as (select p, e, list(v order by i) as c from m{r} group by p, e)")
            steps.append(f"b{r + 1} as materialized (select p, e, coalesce(n{r}.c, b{r}.c) as c from b{r} left join n{r} using (p, e))")
    steps.append("sha as (select sha256(string_agg(v::bigint::varchar, ',' order by p, e, i)) as s from (select p, e, unnest(c) as v, generate_subscripts(c, 1) as i from b4))")
    steps.append("rows_ as (select vec_id, label, string_agg(printf('%02x', e::bigint), '' order by p) as code, sum(d)::bigint as error from a4 join kept using (vec_id) group by vec_id, label)")
    return f"with {', '.join(steps)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, s as codebooks_sha256 from rows_, sha"


ORACLE = _oracle()
