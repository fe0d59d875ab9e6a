"""Product codes of vectors: Lloyd's rounds that look again only at entries that moved.

Every part of a vector keeps its nearest entry and the exact distance to it. If that entry did not
move, the other entries that did not move are still no nearer, so only moved ones are compared with
the stored distance. All other parts look at the whole codebook. All numbers are integers, so sums
and ties do not depend on how rows are spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from metricloom.session import materialize, scratch, work_dir

c = F.col
LIMIT = 1 << 24  # integers beyond are held at it, so no distance leaves 64 bits
CHUNK = 1 << 21  # distances computed at once
SMALL = 100_000  # sums of so many groups are sent to every task; more are joined with salt
SALT = 32


def quantize(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """``q`` = floor(scale * x) of every component in place of the vector; unusable rows are left out."""
    fields = vectors.schema.fields
    at = [f.name for f in fields].index(vector)
    schema = StructType([f for k, f in enumerate(fields) if k != at] + [StructField("q", ArrayType(IntegerType(), False), False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(at).is_valid())
            lists = batch.column(at)
            x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)  # null components become NaN
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            good = np.bincount(row[~np.isfinite(x)], minlength=len(size)) == 0
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.clip(np.floor(x[good[row]] * scale), -LIMIT, LIMIT).astype(np.int32)
            first = np.append(0, np.cumsum(size[good])).astype(np.int32)
            rest = batch.filter(pa.array(good, pa.bool_()))
            made = pa.ListArray.from_arrays(pa.array(first), pa.array(q))
            yield pa.RecordBatch.from_arrays([*[rest.column(k) for k in range(len(fields)) if k != at], made], names)

    return vectors.mapInArrow(run, schema)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``book``, both of integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if x.shape[1] * 4 * most * most < 1 << 53:  # then every number below is an integer that a double holds
        x, book = x.astype(np.float64), book.astype(np.float64)
        out = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)
        return out.astype(np.int64)
    out = np.empty((len(x), len(book)), np.int64)
    for k, entry in enumerate(book.astype(np.int64)):
        out[:, k] = ((x - entry) ** 2).sum(axis=1)
    return out


def nearest(x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray, far: np.ndarray) -> int:
    """Bring ``entry`` and ``far`` of one part of all rows up to date; returns distances computed.

    An ``entry`` of -1 has none yet.
    """
    active = np.flatnonzero(moved)
    kept = (entry >= 0) & ~moved[entry]
    work = 0
    for stored, some in ((False, np.arange(len(book))), (True, active)):
        rows = np.flatnonzero(kept == stored)
        if not len(some):
            continue
        step = max(1, CHUNK // len(some))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            d = distances(x[part], book[some])
            best = d.argmin(axis=1)  # the first, and with it the lowest index, of equals
            new, found = some[best], d[np.arange(len(part)), best]
            if stored:
                better = (found < far[part]) | (found == far[part]) & (new < entry[part])
                part, new, found = part[better], new[better], found[better]
            entry[part], far[part] = new, found
            work += d.size
    return work


def assign(state: DataFrame, books: np.ndarray, moved: np.ndarray, sums: bool) -> DataFrame:
    """One pass: rows (``kind`` 0) with their new entries and distances, and partial sums (``kind`` 1).

    A sum row holds the parts of one task that chose ``entry`` of ``part``: their number and, for
    each position, their total. So the rows are read and written once a round.
    """
    parts, size, width = books.shape
    held = state.sparkSession.sparkContext.broadcast((books, moved))
    added = [("kind", LongType()), ("part", LongType()), ("book_entry", LongType()), ("n", LongType()), ("totals", ArrayType(LongType(), True))]
    schema = StructType(list(state.schema.fields) + [StructField(n, t) for n, t in added])
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
    fields = state.schema.names
    arrow = [state.schema[f].dataType for f in fields]
    q_at, near_at, far_at = (fields.index(x) for x in ("q", "near", "far"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        books, moved = held.value
        total, count, seen = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), False
        types = [to_arrow_type(t) for t in arrow] + [to_arrow_type(t) for _, t in added]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            seen = True
            x = batch.column(q_at).flatten().to_numpy().reshape(n, parts, width)
            near = batch.column(near_at).flatten().to_numpy().reshape(n, parts).astype(np.int64)
            far = batch.column(far_at).flatten().to_numpy().reshape(n, parts).copy()
            for p in range(parts):
                entry, d = near[:, p].copy(), far[:, p].copy()
                nearest(x[:, p], books[p], moved[p], entry, d)
                near[:, p], far[:, p] = entry, d
                if sums:
                    np.add.at(total[p], entry, x[:, p].astype(np.int64))
                    count[p] += np.bincount(entry, minlength=size)
            ends = pa.array(np.arange(0, n * parts + 1, parts, dtype=np.int32))
            out = [batch.column(k) for k in range(len(fields))]
            out[near_at] = pa.ListArray.from_arrays(ends, pa.array(near.ravel().astype(np.int16)))
            out[far_at] = pa.ListArray.from_arrays(ends, pa.array(far.ravel()))
            out += [pa.array(np.zeros(n, np.int64)), *[pa.nulls(n, t) for t in types[len(fields) + 1 :]]]
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(out, types)], schema.names)
        if sums and seen:
            p, e = np.nonzero(count)
            out = [pa.nulls(len(p), t) for t in types[: len(fields)]]
            out += [pa.array(np.ones(len(p), np.int64)), pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), types[-1])]
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(out, types)], schema.names)

    return state.mapInArrow(run, schema)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _lloyd(vectors: DataFrame, key: str, vector: str, parts: int, entries: int, rounds: int, scale: int) -> tuple[DataFrame, np.ndarray]:
    spark = vectors.sparkSession
    raw = materialize(quantize(vectors, vector, scale), "codes-raw")
    order = [c(f"`{key}`").asc_nulls_last(), c("q")]
    first = raw.where((F.size("q") > 0) & (F.size("q") % parts == 0)).orderBy(*order).limit(1).select(F.size("q")).collect()
    width = first[0][0] // parts if first else 0
    empty = [F.lit(-1).cast("smallint")] * parts, [F.lit(0).cast("bigint")] * parts
    state = raw.where(F.size("q") == width * parts if width else F.lit(False)).withColumns({"near": F.array(*empty[0]), "far": F.array(*empty[1])})
    # the first entries are a bounded number of rows: one codebook
    seeds = np.array([r["q"] for r in state.orderBy(*order).limit(entries).select("q").collect()], np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    moved = np.ones(books.shape[:2], bool)
    before = None
    for r in range(rounds + 1):
        path = work_dir(spark, f"codes-round-{r}")
        last = r == rounds
        out = assign(state, books, moved, not last)
        out.write.partitionBy("kind").parquet(path)
        if before:
            _delete(spark, before)
        before = path
        table = spark.read.schema(out.schema).parquet(path)
        state = table.where("kind = 0").select(*state.columns)
        if last or not len(seeds):  # nothing usable: one pass writes the empty table
            break
        sums = table.where("kind = 1").select("part", "book_entry", "n", F.posexplode("totals").alias("place", "total"))
        sums = sums.groupBy("part", "book_entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = books.copy()
        for row in sums.collect():  # one number for each number of the codebooks, whatever the table's size
            new[row["part"], row["book_entry"], row["place"]] = row["total"] // row["n"]
        moved = (new != books).any(axis=2)
        books = new
    return materialize(state, "codes-final", keep=True), books


def with_group_sum(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal ``group``; nulls are one group.

    Sums are combined before the shuffle. They are sent to all tasks only if their counted number is
    small; else rows and sums meet by group and salt, so a hot group is spread over tasks.
    """
    sums = materialize(rows.groupBy(c(group).alias("_group")).agg(F.sum(value).alias(name)), "codes-sums", keep=True)
    if sums.count() <= SMALL:
        return rows.join(F.broadcast(sums), rows[group].eqNullSafe(sums["_group"])).drop("_group")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c(f"`{x}`") for x in rows.columns]), F.lit(SALT)))
    sums = sums.withColumn("_salt_of", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(SALT)])))
    return salted.join(sums, salted[group].eqNullSafe(sums["_group"]) & (salted["_salt"] == sums["_salt_of"])).drop("_group", "_salt", "_salt_of")


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", columns: list[str] | None = None,
    parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> tuple[DataFrame, np.ndarray]:
    """(key, columns, entries array<smallint>, distances array<bigint>) of every usable row, and the codebooks.

    A row is usable if its vector holds no null and no component that is not finite, and has the
    length of the usable vector with the smallest key whose length is a multiple of ``parts``; other
    rows are left out. Components become floor(scale * x), held at 2**24 either way. Part p's codebook
    begins as part p of the ``entries`` smallest keys (equal keys by vector, null keys last; fewer
    rows give fewer entries; repeated rows give equal entries, of which the lowest is used). Each of
    ``rounds`` rounds assigns parts to nearest entries, ties to the lower index, and replaces used
    entries by floor(mean); parts are assigned once more in the end. An empty table gives an empty
    one and codebooks without entries. Codebooks are (parts, entries, length) integers.

    The rows are written once a round and the round before is deleted; the driver sees codebooks only.
    """
    columns = [] if columns is None else columns
    with scratch(vectors.sparkSession):
        names = [key, *columns]
        slim = vectors.select(*[c(f"`{x}`").alias(f"_{k}") for k, x in enumerate(names)], c(f"`{vector}`").alias("vector"))
        out, books = _lloyd(slim, "_0", "vector", parts, entries, rounds, scale)
    return out.select(*[c(f"_{k}").alias(x) for k, x in enumerate(names)], c("near").alias("entries"), c("far").alias("distances")), books


def code_text(entries: str = "entries"):
    """Two hexadecimal digits for each part (codebooks of at most 256 entries)."""
    return F.lower(F.array_join(F.transform(entries, lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), ""))


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
