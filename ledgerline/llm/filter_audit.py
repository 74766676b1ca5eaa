"""What five filters remove alone, together and in every order, by exact constrained least squares.

Every document gets one bit per failed filter, so a part (a language) is described by 32 counts. From
them the removals v(S) of all 32 coalitions S are tabulated. The Shapley values are the solution of the
kernel-weighted least squares

    min sum over S of w(S) * (v(S) - sum of phi_i in S)^2,   subject to   sum of phi_i = v(all),

whose normal equations are solved in rationals; times the number of orders they are whole numbers. The
steps of an order need no further pass: with S applied before filter i, it removes v(S + i) - v(S).

Failure conditions, on words ``[^\\x20\\x09-\\x0D]+`` of the whole text: A under 100 words; B
100 * distinct words < 80 * words; C 100 * ``[A-Z]`` > 10 * code points; D any of ``#$%&*|``; E the text
equals that of a smaller doc_id.

A null text is the empty text and a null lang the empty string. Null ids are larger than any other and
equal to each other; rows of one id never fail E by each other, so repeated rows have equal results. A
document is good or toxic if any label of its id says so; null ids have no labels. An empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import doc_key, map_batches, stored

FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SYMBOLS = "[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ROWS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failures(documents: DataFrame) -> DataFrame:
    """(doc_key, part, digest, mask, n): documents that agree in all four, with bits of A to D."""
    words = F.filter(F.split("body", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    measured = (
        documents.select(
            doc_key().alias("doc_key"),
            F.coalesce("lang", F.lit("")).alias("part"),
            F.coalesce("text", F.lit("")).alias("body"),
        )
        .withColumn("words", words)
        .select(
            "doc_key",
            "part",
            F.sha2("body", 256).alias("digest"),
            F.size("words").alias("n_words"),
            F.size(F.array_distinct("words")).alias("n_distinct"),
            F.length("body").alias("n_chars"),
            F.length(F.translate("body", UPPER, "")).alias("n_other"),
            F.col("body").rlike(SYMBOLS).alias("symbols"),
        )
    )
    conditions = (
        F.col("n_words") < LEAST_WORDS,
        F.lit(100) * F.col("n_distinct") < F.lit(DISTINCT_PERCENT) * F.col("n_words"),
        F.lit(100) * (F.col("n_chars") - F.col("n_other")) > F.lit(UPPER_PERCENT) * F.col("n_chars"),
        F.col("symbols"),
    )
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))
    return (
        measured.select("doc_key", "part", "digest", mask.alias("mask"))
        .groupBy("doc_key", "part", "digest", "mask")
        .agg(F.count("*").alias("n"))
    )


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows per part.

    Only the smallest doc_id of a text passes E. The join that marks it has the id in its key, so a
    text in a third of all documents is no hot key.
    """
    rows = stored(failures(documents))
    firsts = rows.groupBy("digest").agg(F.min("doc_key").alias("doc_key"))
    firsts = firsts.withColumn("first", F.lit(True))
    marks = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_key"))
        .agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    )
    repeat = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return (
        rows.join(firsts, ["digest", "doc_key"], "left")
        .join(marks, "doc_key", "left")
        .groupBy("part", (F.col("mask") + repeat).alias("mask"))
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )


def coalition_removals(counts: list[int]) -> list[int]:
    """Per coalition: the documents that fail at least one of its filters, from counts by mask."""
    total = sum(counts)
    return [
        total - sum(n for mask, n in enumerate(counts) if not mask & coalition)
        for coalition in range(len(counts))
    ]


@lru_cache
def _inverse(players: int) -> list[list[Fraction]]:
    """Inverse of the normal equations of the constrained kernel regression, the last row its constraint.

    The matrix is the same for every part: weights depend on the sizes of coalitions alone.
    """
    size = players + 1
    matrix = [[Fraction(0)] * size for _ in range(size)]
    for coalition in range(1, (1 << players) - 1):
        weight = kernel_weight(players, coalition.bit_count())
        members = [i for i in range(players) if coalition >> i & 1]
        for i in members:
            for j in members:
                matrix[i][j] += weight
    for i in range(players):  # the constraint with its multiplier
        matrix[i][players] = matrix[players][i] = Fraction(1)
    rows = [row + [Fraction(int(i == j)) for j in range(size)] for i, row in enumerate(matrix)]
    for column in range(size):
        pivot = next(r for r in range(column, size) if rows[r][column])
        rows[column], rows[pivot] = rows[pivot], rows[column]
        head = rows[column][column]
        rows[column] = [x / head for x in rows[column]]
        for r in range(size):
            if r != column and (factor := rows[r][column]):
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[column])]
    return [row[size:] for row in rows]


def kernel_weight(players: int, size: int) -> Fraction:
    return Fraction(players - 1, comb(players, size) * size * (players - size))


def shapley_values(removals: list[int]) -> list[Fraction]:
    """Shapley value of each filter from the removals of all coalitions."""
    players = len(removals).bit_length() - 1
    right = [Fraction(0)] * (players + 1)
    for coalition in range(1, len(removals) - 1):
        weight = kernel_weight(players, coalition.bit_count()) * removals[coalition]
        for i in range(players):
            if coalition >> i & 1:
                right[i] += weight
    right[players] = Fraction(removals[-1])
    return [sum(a * b for a, b in zip(row, right)) for row in _inverse(players)[:players]]


def order_rows(counts: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    players = len(FILTERS)
    v, v_good, v_toxic = map(coalition_removals, (counts, good, toxic))
    everyone = sum(counts)
    orders = factorial(players)
    shapley = [orders * value for value in shapley_values(v)]
    assert all(value.denominator == 1 for value in shapley)
    fails = [v[1 << i] for i in range(players)]
    alone = [v[-1] - v[len(v) - 1 - (1 << i)] for i in range(players)]
    found = []
    for order in permutations(range(players)):
        name = "".join(FILTERS[i] for i in order)
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = v[after] - v[before]
            found.append(
                (
                    name,
                    step,
                    everyone - v[after],
                    removed,
                    fails[i] - removed,
                    alone[i],
                    v_good[after] - v_good[before],
                    v_toxic[after] - v_toxic[before],
                    int(shapley[i]),
                )
            )
            before = after
    return found


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    entry = F.struct("mask", "n", "good", "toxic")
    parts = (
        mask_counts(documents, labels)
        .groupBy("part")
        .agg(F.collect_list(entry).alias("entries"))  # at most one entry per mask
    )

    def function(batch):
        for part, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tables = [[0] * (1 << len(FILTERS)) for _ in range(3)]
            for entry in entries:
                for table, name in zip(tables, ("n", "good", "toxic")):
                    table[entry["mask"]] += entry[name]
            columns = list(zip(*order_rows(*tables)))
            yield {
                field.split()[0]: values
                for field, values in zip(ROWS.split(", "), ([part] * len(columns[0]), *columns))
            }

    return map_batches(parts, function, ROWS)
