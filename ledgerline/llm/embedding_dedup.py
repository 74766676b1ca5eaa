"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosines and connected components.

Equal vectors are one class, so copies collapse before anything is compared. A class gets one bucket in
each of L tables: the signs of k random projections. Two vectors at the angle a agree in one sign with
probability 1 - a / pi; k grows with the logarithm of the number of classes, so that unrelated vectors
fill buckets of about ``BUCKET``, and L is the number of tables that finds a pair just at the threshold
with probability ``RECALL`` or more, at every size. A pair is counted in the first table where it
meets, which both signatures tell, so links are counted without listing pairs.

A bucket of more than ``BLOCK`` classes is compared block by block. Before that, dense groups are taken
out: each such bucket names a leader, and vectors within half the threshold's angle of one leader are
all linked with each other by the triangle inequality. Such a core is counted by its size; its members
are compared only with vectors outside of it. All other pairs of the bucket are compared, in cells of
two blocks, and a cell reports counts and a spanning forest.

Links are pairs with a cosine of at least ``SIMILAR`` in double precision; vectors of different lengths,
and vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Each row
is a vector of its own: rows of one vec_id can link with each other, and repeated rows do. A null vec_id
is larger than any other; a component of null ids alone has a null id, and its rows count as kept. An
empty table gives no rows; extra columns, labels included, are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ledgerline.llm.common import NULL_ID, apply_arrow, doc_key, map_batches, slices, stored
from ledgerline.llm.components import components

SIMILAR = 0.9
#: Probability at which a pair with the least cosine meets in some table.
RECALL = 0.995
#: Unrelated classes of a bucket.
BUCKET = 256
#: Classes of a block; a cell compares at most two blocks.
BLOCK = 2048
SEED = 11
#: Rows of one class that are joined in one task.
CLASS_ROWS = 50_000
#: Slack of angles and cosines against rounding.
SLACK = 1e-9


def table_settings(classes: int, similar: float = SIMILAR) -> tuple[int, int]:
    """(bits, tables) for a number of classes."""
    bits = min(31, max(1, math.ceil(math.log2(max(classes, 1) / BUCKET))))
    meet = (1 - math.acos(similar) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


@lru_cache(maxsize=4)
def _planes(length: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, count))


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow or underflow."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def signatures(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One number of ``bits`` signs per row and table."""
    found = np.empty((len(units), tables), dtype=np.int32)
    planes = _planes(units.shape[1], bits * tables)
    weights = (1 << np.arange(bits)).astype(np.int64)
    for part in slices(len(units), 1024):
        signs = (units[part] @ planes > 0).reshape(-1, tables, bits)
        found[part] = (signs * weights).sum(axis=2)
    return found


def _marked(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_key, nr, digest, length, vector) per row and the numpy type of the packed vectors.

    The digest is null for a vector that links with nothing; ``nr`` numbers the rows of a batch.
    """
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"

    def function(batch):
        column = batch.column(1)
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # no negative zero
        digests, packed, lengths = [], [], []
        for k, valid in enumerate(column.is_valid().to_pylist()):
            row = values[offsets[k] : offsets[k + 1]]
            if not valid or not row.any() or not np.isfinite(row).all():
                digests.append(None)
                packed.append(None)
            else:
                packed.append(row.astype(kind).tobytes())
                digests.append(hashlib.blake2b(packed[-1], digest_size=16).digest())
            lengths.append(len(row))
        yield {
            "vec_key": batch.column(0),
            "nr": np.arange(batch.num_rows, dtype=np.int32),
            "digest": digests,
            "length": np.array(lengths, dtype=np.int32),
            "vector": packed,
        }

    array = ArrayType(FloatType()) if single else "array<double>"
    source = vectors.select(doc_key("vec_id").alias("vec_key"), F.col("embedding").cast(array))
    schema = "vec_key long, nr int, digest binary, length int, vector binary"
    return map_batches(source, function, schema), kind


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors of one length as rows."""
    return np.stack([np.frombuffer(value.as_py(), dtype=kind) for value in column])


def _signed(classes: DataFrame, kind: str, bits: int, tables: int) -> DataFrame:
    """The classes with their signatures."""

    def function(batch):
        lengths = batch.column(1).to_numpy()
        for length in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == length))
            found = signatures(unit_rows(_matrix(part.column(3), kind)), bits, tables)
            columns = {name: part.column(k) for k, name in enumerate(("digest", "length", "n", "vector"))}
            yield columns | {"sigs": list(found)}

    chosen = classes.select("digest", "length", "n", "vector")
    return map_batches(chosen, function, "digest binary, length int, n long, vector binary, sigs array<int>")


def _copies(signed: DataFrame, *columns: str) -> DataFrame:
    """One row per class and table."""
    return signed.select("length", F.posexplode("sigs").alias("table", "bucket"), *columns)


_BUCKET_KEY = ["length", "table", "bucket"]


def _cores(signed: DataFrame, hot: DataFrame, kind: str, similar: float) -> DataFrame:
    """(digest, core): classes within half the threshold's angle of a leader, named by its digest.

    The leader of a hot bucket is its smallest digest, which is a random member; a vector takes the
    smallest leader that is near enough, so that a dense group mostly agrees on one.
    """
    least = math.cos(math.acos(similar) / 2 - SLACK)
    leaders = (
        _copies(signed, "digest", "vector")
        .join(hot.select(*_BUCKET_KEY), _BUCKET_KEY)
        .groupBy(*_BUCKET_KEY)
        .agg(F.min(F.struct("digest", "vector")).alias("leader"))
        .select(*_BUCKET_KEY, F.col("leader.digest").alias("core"), F.col("leader.vector").alias("centre"))
    )

    def near(batch):
        lengths = batch.column(0).to_numpy()
        for length in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == length))
            rows, centres = (unit_rows(_matrix(part.column(k), kind)) for k in (2, 4))
            chosen = part.filter(pa.array((rows * centres).sum(axis=1) >= least))
            yield {"digest": chosen.column(1), "core": chosen.column(3)}

    met = _copies(signed, "digest", "vector").join(stored(leaders), _BUCKET_KEY)
    met = met.select("length", "digest", "vector", "core", "centre")
    return map_batches(met, near, "digest binary, core binary").groupBy("digest").agg(F.min("core").alias("core"))


def _cells(signed: DataFrame, hot: DataFrame) -> DataFrame:
    """(bucket key, low, high, part, class): what is compared with each other.

    A usual bucket is one cell. Blocks of a hot one are numbered, those of its largest core last; two
    blocks of that core never meet.
    """
    in_hot = _copies(signed, "core").join(hot.select(*_BUCKET_KEY), _BUCKET_KEY)
    by_core = in_hot.groupBy(*_BUCKET_KEY, "core").agg(F.count("*").alias("members"))
    size = F.coalesce("largest.members", F.lit(0))
    plans = stored(
        by_core.groupBy(*_BUCKET_KEY)
        .agg(
            F.max(F.when(F.col("core").isNotNull(), F.struct("members", "core"))).alias("largest"),
            F.sum("members").alias("all"),
        )
        .select(
            *_BUCKET_KEY,
            F.col("largest.core").alias("main"),
            F.ceil(size / F.lit(BLOCK)).cast("int").alias("core_blocks"),
            F.ceil((F.col("all") - size) / F.lit(BLOCK)).cast("int").alias("blocks"),
        )
    )
    member = F.col("core").eqNullSafe(F.col("main")) & F.col("main").isNotNull()
    salt = F.xxhash64("digest", "table")
    part = (
        F.when(F.col("blocks").isNull(), 0)
        .when(member, F.col("blocks") + F.pmod(salt, F.greatest("core_blocks", F.lit(1))))
        .otherwise(F.pmod(salt, F.greatest("blocks", F.lit(1))))
        .cast("int")
    )
    last = F.when(F.col("part") < F.col("blocks"), F.col("blocks") + F.col("core_blocks")).otherwise(
        F.col("blocks")
    )
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(
        last > 0, F.sequence(F.lit(0), (last - 1).cast("int"))
    )
    return (
        _copies(signed, "digest", "n", "vector", "sigs", "core")
        .join(plans, _BUCKET_KEY, "left")
        .withColumn("part", part)
        .withColumn("other", F.explode(others))
        .select(
            *_BUCKET_KEY,
            F.least("part", "other").alias("low"),
            F.greatest("part", "other").alias("high"),
            "part",
            "digest",
            "n",
            "vector",
            "sigs",
            "core",
        )
    )


def forest(linked: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix of links: the first row of its component."""
    size = len(linked)
    root = np.arange(size)
    seen = ~linked.any(axis=1)
    for start in range(size):
        if seen[start]:
            continue
        front = np.zeros(size, dtype=bool)
        front[start] = seen[start] = True
        while front.any():
            front = linked[front].any(axis=0) & ~seen
            seen |= front
            root[front] = start
    return root


def compare_cell(
    units: np.ndarray,
    weights: np.ndarray,
    sigs: np.ndarray,
    cores: np.ndarray,
    table: int,
    low: np.ndarray,
    high: np.ndarray,
    similar: float = SIMILAR,
) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) per row from the pairs of ``low`` and ``high`` rows that first meet in ``table``.

    ``cores`` has one number per core, negative for none; pairs within a core are left out.
    """
    linked = np.zeros((len(units), len(units)), dtype=bool)
    for part in slices(len(low), 512):
        rows = low[part]
        found = units[rows] @ units[high].T >= similar
        i, j = np.nonzero(found)
        i, j = rows[i], high[j]
        new = (i != j) & ((cores[i] < 0) | (cores[i] != cores[j]))
        i, j = i[new], j[new]
        for piece in slices(len(i), 1 << 16):
            a, b = i[piece], j[piece]
            first = ~(sigs[a, :table] == sigs[b, :table]).any(axis=1)
            linked[a[first], b[first]] = linked[b[first], a[first]] = True
    return linked @ weights, forest(linked)


def _links(cells: DataFrame, kind: str, similar: float) -> DataFrame:
    """(digest, links, root): counts and edges of each cell's spanning forest."""

    def function(table: pa.Table) -> pa.Table:
        digest = table.column("digest").combine_chunks()
        part = table.column("part").to_numpy()
        low, high = (np.flatnonzero(part == table.column(name)[0].as_py()) for name in ("low", "high"))
        units = unit_rows(_matrix(table.column("vector"), kind))
        sigs = np.stack(table.column("sigs").to_numpy())
        names = table.column("core").combine_chunks().dictionary_encode().indices
        cores = names.fill_null(-1).to_numpy(zero_copy_only=False)
        weights = table.column("n").to_numpy()
        number = table.column("table")[0].as_py()
        links, root = compare_cell(units, weights, sigs, cores, number, low, high, similar)
        chosen = np.flatnonzero(links)
        rooted = pa.array(np.where(root == np.arange(len(root)), -1, root)[chosen])
        heads = digest.take(pa.compute.if_else(pa.compute.less(rooted, 0), None, rooted))
        return pa.table(
            {"digest": digest.take(pa.array(chosen)), "links": pa.array(links[chosen], pa.int64()), "root": heads}
        )

    grouped = cells.groupBy(*_BUCKET_KEY, "low", "high")
    return apply_arrow(grouped, function, "digest binary, links long, root binary")


def near_vectors(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Per row of (vec_id, embedding): n_links, component_id and kept."""
    marked, kind = _marked(vectors)
    marked = stored(marked)
    usable = marked.where(F.col("digest").isNotNull())
    classes = stored(
        usable.groupBy("digest").agg(
            F.first("length").alias("length"),
            F.first("vector").alias("vector"),
            F.count("*").alias("n"),
            F.min("vec_key").alias("rep"),
        )
    )
    bits, tables = table_settings(classes.count(), similar)
    signed = stored(_signed(classes, kind, bits, tables))
    hot = stored(_copies(signed).groupBy(*_BUCKET_KEY).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    cores = stored(_cores(signed, hot, kind, similar))
    cored = signed.join(cores, "digest", "left")
    links = stored(_links(_cells(cored, hot), kind, similar))

    edges = links.where(F.col("root").isNotNull()).select(F.col("digest").alias("a"), F.col("root").alias("b"))
    edges = edges.union(cores.where("digest <> core").select("digest", "core"))
    labels = components(edges)

    core_sizes = (
        classes.select("digest", "n").join(cores, "digest").groupBy("core").agg(F.sum("n").alias("core_n"))
    )
    counted = links.groupBy("digest").agg(F.sum("links").alias("links"))
    rooted = stored(
        classes.select("digest", "n", "rep")
        .join(counted, "digest", "left")
        .join(cores, "digest", "left")
        .join(core_sizes, "core", "left")
        .join(labels.withColumnRenamed("node", "digest"), "digest", "left")
        .select(
            "digest",
            "n",
            "rep",
            F.coalesce("root", "digest").alias("root"),
            # copies of the vector itself, its core's other classes, links outside of the core
            (F.coalesce("core_n", "n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    named = rooted.join(smallest, "root")

    # rows of a class that is copied very often are dealt over several tasks
    salts = F.ceil(F.col("n") / F.lit(CLASS_ROWS)).cast("int")
    frequent = stored(rooted.where(F.col("n") > CLASS_ROWS).select("digest", salts.alias("salts")))
    result = named.select(
        "digest", "n_links", "component", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    rows = marked.select("vec_key", "nr", "digest").join(frequent, "digest", "left")
    rows = rows.withColumn("salt", F.pmod("nr", F.coalesce("salts", F.lit(1))))
    component = F.coalesce("component", "vec_key")
    return rows.join(result, ["digest", "salt"], "left").select(
        F.when(F.col("vec_key") != NULL_ID, F.col("vec_key")).alias("vec_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(component != NULL_ID, component).alias("component_id"),
        (F.col("vec_key") == component).alias("kept"),
    )
