"""Quality rules with thresholds that follow each language and source.

The measures of a document are built-in array and string functions; nothing leaves the JVM. Instead
of fixed cutoffs, each (lang, source) has a mergeable KLL quantile sketch per measure, built with
map-side partial sketches, so a source with a third of all rows is no hot task. From the quartiles a
fence is drawn: ``reach`` interquartile ranges beyond the quartile, and never less than ``least`` beyond
it, so that sources of uniform texts do not reject small deviations. Sketches of sources with fewer
than ``SMALL_GROUP`` documents are replaced by the merged sketch of their language, and that of
rare languages by the merged sketch of all. The fences are written once; Spark broadcasts them in the
join if the written table is below its threshold and shuffles otherwise.

A document that fails the base rule is not kept. Measures that say nothing about short texts are
judged from ``SHORT`` words on; a measure that is undefined (no words, no lines) passes.

Sketches hold ``SKETCH_K`` items a level and are exact for groups up to about that size; beyond it the
rank error is below 0.2 %, and runs may differ in documents that lie on a fence.

Nulls are empty texts, which fail the base rule; null languages and sources are groups like others.
Rows are judged row by row, repeated rows alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stored

WHITE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
# Fixed values of the base rule.
_SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30

SMALL_GROUP = 200
SHORT = 50
SKETCH_K = 2000


@dataclass(frozen=True)
class Measure:
    """A fence: ``reach`` quartile distances, at least ``least``, above (and below) the quartiles."""

    name: str
    reach: float
    least: float
    below: bool = False


MEASURES = (
    Measure("symbol_rate", 4.0, 0.25),
    Measure("mean_word", 5.0, 1.25, below=True),
    Measure("dup_line_share", 4.0, 0.5),
    Measure("repeat_share", 4.0, 0.3),
    Measure("upper_share", 5.0, 0.3),
)


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _without(column: Column, letters: str) -> Column:
    return F.translate(column, letters, "")


def measured(documents: DataFrame) -> DataFrame:
    """``documents`` with the base columns and the measures added."""
    frame = documents.withColumn("_w", F.array_remove(F.split(_text(), WHITE), ""))
    frame = frame.withColumn("_wh", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_wh")
    # a column that is read once is inlined by the optimizer, into a lambda too, and would then be
    # computed for every element: the arrays below are read at least twice where lambdas use them
    frame = frame.withColumn(
        "_h",
        F.when(
            n >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), n - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("_wh", i, WINDOW)),
            ),
        ),
    )
    frame = frame.withColumn("_n_repeat", F.size(F.array_distinct("_h")) < F.size("_h"))
    # only texts with a repeated window go further: sort by hash, then compare the words themselves
    frame = frame.withColumn(
        "_s",
        F.when(
            F.col("_n_repeat"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    frame = frame.withColumn("_d", F.filter("_s", lambda x, j: _has_twin("_s", j, "h")))
    frame = frame.withColumn(
        "_t",
        F.sort_array(
            F.transform(
                "_d",
                lambda x: F.struct(
                    F.slice("_w", x["i"] + 1, WINDOW).alias("w"), x["i"].alias("i")
                ),
            )
        ),
    )
    frame = frame.withColumn(
        "_p",
        F.sort_array(
            F.transform(F.filter("_t", lambda x, j: _has_twin("_t", j, "w")), lambda x: x["i"])
        ),
    )
    steps = F.transform(
        "_p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - x, F.lit(WINDOW)))
    )
    frame = frame.withColumn(
        "_r", F.coalesce(F.aggregate(steps, F.lit(0), lambda total, x: total + x), F.lit(0))
    )
    frame = frame.withColumn(
        "_l", F.filter(F.split(_text(), "\n"), lambda x: F.length(_without(x, _BLANKS)) > 0)
    )
    frame = frame.withColumn("_c", _without(_text(), _BLANKS))
    letters = F.length("_c")
    count = F.size("_w")
    lines, dup = F.size("_l"), F.size("_l") - F.size(F.array_distinct("_l"))
    symbols = letters - F.length(_without(F.col("_c"), _SYMBOLS))
    long_enough = count >= SHORT
    upper = letters - F.length(F.regexp_replace("_c", r"\p{Lu}", ""))
    base = {
        "n_words": count.cast("long"),
        "word_chars": letters.cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": F.col("_r").cast("long"),
        "base_failed": (count < LEAST_WORDS) | (100 * F.col("_r") > REPEAT_PERCENT * count),
        "symbol_rate": F.when(long_enough, symbols / count),
        "mean_word": F.when(long_enough, letters / count),
        "dup_line_share": F.when(long_enough & (lines > 0), dup / lines),
        "repeat_share": F.when(long_enough, F.col("_r") / count),
        "upper_share": F.when(long_enough, upper / letters),
    }
    helpers = ["_w", "_wh", "_h", "_n_repeat", "_s", "_d", "_t", "_p", "_r", "_l", "_c"]
    return frame.select("*", *(c.alias(k) for k, c in base.items())).drop(*helpers)


def _has_twin(array: str, place: Column, field: str) -> Column:
    own = F.get(array, place)[field]
    before = F.when(place > 0, F.get(array, place - 1)[field] == own)
    return F.coalesce(before, F.lit(False)) | F.coalesce(
        F.get(array, place + 1)[field] == own, F.lit(False)
    )


def fences(measures: DataFrame) -> DataFrame:
    """(lang, source, low_*, high_*) from the sketches of the measured documents."""
    sketches = [
        F.kll_sketch_agg_double(m.name, F.lit(SKETCH_K)).alias(m.name) for m in MEASURES
    ]
    by_source = stored(
        measures.where(F.col("n_words") >= SHORT)
        .groupBy("lang", "source")
        .agg(F.count("*").alias("n"), *sketches)
    )
    merged = [F.kll_merge_agg_double(m.name).alias(m.name) for m in MEASURES]
    by_lang = by_source.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    # one row by construction, read as a scalar
    overall = by_source.groupBy().agg(F.struct(*merged).alias("all")).scalar()
    groups = measures.select("lang", "source").distinct()
    joined = (
        groups.alias("g")
        .join(
            by_source.alias("s"),
            F.col("g.lang").eqNullSafe(F.col("s.lang")) & F.col("g.source").eqNullSafe(F.col("s.source")),
            "left",
        )
        .join(by_lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")), "left")
    )
    columns = [F.col("g.lang").alias("lang"), F.col("g.source").alias("source")]
    for m in MEASURES:
        sketch = (
            F.when(F.col("s.n") >= SMALL_GROUP, F.col(f"s.{m.name}"))
            .when(F.col("l.n") >= SMALL_GROUP, F.col(f"l.{m.name}"))
            .otherwise(overall[m.name])
        )
        low, high = (
            F.when(
                F.kll_sketch_get_n_double(sketch) > 0,
                F.kll_sketch_get_quantile_double(sketch, F.lit(q)),
            )
            for q in (0.25, 0.75)
        )
        margin = F.greatest(m.reach * (high - low), F.lit(m.least))
        columns.append((high + margin).alias(f"high_{m.name}"))
        if m.below:
            columns.append((low - margin).alias(f"low_{m.name}"))
    return joined.select(*columns)


def _verdict() -> Column:
    """All rules as one value, not a conjunction: the optimizer would push parts of a conjunction
    below the projections of the measures and copy their expressions into one another."""
    rules = [~F.col("base_failed")]
    for m in MEASURES:
        inside = F.col(m.name) <= F.col(f"high_{m.name}")
        if m.below:
            inside &= F.col(m.name) >= F.col(f"low_{m.name}")
        rules.append(F.coalesce(inside, F.lit(True)))
    return F.forall(F.array(*rules), lambda rule: rule)


def judged(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """``measures`` with the column ``kept``."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return measures.join(limits, same, "left").withColumn("kept", _verdict())


def _inputs(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", "lang", "source")


def assess(documents: DataFrame) -> DataFrame:
    """Per document row: base columns, measures, verdict."""
    measures = stored(measured(_inputs(documents)).drop("text"))
    return judged(measures, stored(fences(measures))).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        *(m.name for m in MEASURES),
    )


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are kept, with their own columns only.

    Only the measures of the first pass are written, not the texts: the second pass measures again.
    """
    limits = stored(fences(stored(measured(_inputs(documents)).drop("text", "doc_id"))))
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")
    rows = documents.select(whole, "text", "lang", "source")
    return judged(measured(rows), limits).where("kept").select("_row.*")
