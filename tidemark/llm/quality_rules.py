"""Quality rules with thresholds that follow each language and source.

Every text gets counts (words, symbols, repeated lines and three-word windows) and from them whole-number metrics. Their
distribution in each (language, source) is held as a log-linear histogram: a value keeps its leading ``PRECISION`` bits, so
quantiles are within 1/64 and histograms merge by adding counts, whatever the order. A group's quartiles count with its rows,
those of its language with ``prior`` rows more, and a language's are drawn to those of the whole corpus likewise, so the
smaller a group, the more it follows what it is part of. A document is kept if it passes the base rules and each metric lies
within the fences of its group, which are these quartiles widened by ``spread`` times their distance (or a least distance,
for groups whose documents hardly differ).

All of it is DataFrame work; a text is read once, and only the narrow counts are kept between the two passes. Windows are
compared by hash and place in one sort of numbers, then by their words where hashes agree; should two windows of a text share
a hash, that text's windows are sorted by their words. Counts are exact.

Null and empty texts have no words and fail the base rules. Null language and source form groups of their own. A text is
one row's work however long it is, at about 100 bytes of memory a word. Rows are counted and judged one by one, so ties and
repeated rows agree; an empty table gives an empty result; other columns are ignored, or kept by ``passing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.durable import save

GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
PRECISION = 7
#: Metric, its value from the counts, whether it has a lower fence, and the least distance of quartiles.
METRICS = {
    "symbols": ("1000 * n_symbols div nullif(n_words, 0)", False, 50),
    "lines": ("1000 * n_dup_lines div nullif(n_lines, 0)", False, 300),
    "repeats": ("1000 * n_repeat_words div nullif(n_words, 0)", False, 100),
    "width": ("100 * word_chars div nullif(n_words, 0)", True, 150),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


#: Hash of a window from those of its words.
WINDOW_HASH = F.xxhash64


def counts(text: Column) -> dict[str, Column]:
    """Counts of a text as columns over ``__text`` and ``__words``, in the order in which they build on each other."""
    n = F.size("__words")
    size = F.lit(1) + F.expr("cast(floor(log2(greatest(size(__words), 1))) as int)")
    return {
        "__words": F.array_remove(F.split(text, GAPS), ""),
        "__lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "n_words": n.cast("bigint"),
        "n_lines": F.size("__lines").cast("bigint"),
        "word_chars": F.char_length(F.array_join("__words", "")).cast("bigint"),
        "n_symbols": (F.octet_length(text) - F.octet_length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "__keys": F.transform("__words", lambda w: F.xxhash64(w)),
        "__windows": F.when(n >= 3, F.transform(F.slice("__keys", F.lit(1), n - 2), lambda h, i: WINDOW_HASH(h, F.get("__keys", i + 1), F.get("__keys", i + 2)))),
        "__bits": size,
        # A window's hash without its low bits, which hold its place: one sort of plain numbers brings equal windows together.
        "__placed": F.sort_array(F.expr("transform(__windows, (h, i) -> shiftleft(shiftright(h, __bits), __bits) | cast(i as bigint))")),
        "__next": F.expr("transform(__placed, (v, i) -> coalesce(shiftright(v, __bits) = shiftright(get(__placed, i + 1), __bits), false))"),
        # Neighbours with one hash are compared word by word; only a text with two windows of one hash is sorted by its words.
        "__clash": F.exists(
            F.expr("filter(transform(__placed, (v, i) -> case when get(__next, i) then struct(cast(v & __mask as int) as p, cast(get(__placed, i + 1) & __mask as int) as q) end), x -> x is not null)".replace("__mask", "(shiftleft(1L, __bits) - 1)")),
            lambda x: F.exists(F.sequence(F.lit(0), F.lit(2)), lambda j: F.get("__words", x["p"] + j) != F.get("__words", x["q"] + j)),
        ),
        "__by_words": F.when(
            F.col("__clash"),
            F.sort_array(F.transform(F.slice("__words", F.lit(1), n - 2), lambda w, i: F.struct(F.array(w, F.get("__words", i + 1), F.get("__words", i + 2)).alias("w"), i.alias("i")))),
        ),
        "__twice": F.when(
            ~F.coalesce("__clash", F.lit(False)),
            F.expr("filter(transform(__placed, (v, i) -> case when get(__next, i) or coalesce(get(__next, i - 1), false) then cast(v & (shiftleft(1L, __bits) - 1) as int) end), p -> p is not null)"),
        ).otherwise(F.expr("filter(transform(__by_words, (v, i) -> case when coalesce(get(__by_words, i + 1).w = v.w, false) or coalesce(get(__by_words, i - 1).w = v.w, false) then v.i end), p -> p is not null)")),
        "n_repeat_words": F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("__twice", lambda p: F.array(p, p + 1, p + 2))))), F.lit(0)).cast("bigint"),
    }


def measure(docs: DataFrame, keep: list[Column], *, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, the counts, ``n_lines`` and ``base_failed`` of every row."""
    df = docs.select(F.struct(*keep).alias("__keep"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    for name, value in counts(F.col("__text")).items():
        df = df.withColumn(name, value)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("__keep.*", *COUNTS, "n_lines", failed.alias("base_failed"))


def _bin(v: Column) -> Column:
    """The lower edge of a value's bin."""
    cut = F.greatest(F.length(F.bin(v)) - PRECISION, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, cut), cut)


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """Mergeable histograms: ``lang``, ``source``, ``metric``, ``bin``, ``n`` of rows that pass the base rules."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).alias("v")) for m, (e, _, _) in METRICS.items()])
    # Failed rows explode to nothing; a filter would be pushed below the counts, which would then be made twice.
    rows = measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(F.when(~F.col("base_failed"), each)).alias("x"))
    return rows.select("lang", "source", "x.metric", _bin(F.col("x.v")).alias("bin")).groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def fences(histograms: DataFrame, *, prior: int = 100, spread: float = 3.0) -> DataFrame:
    """``lang``, ``source`` and ``low_*``, ``high_*`` of each metric.

    Cells are merged upwards, and quantiles are read from running sums; both see at most one row a group, metric and bin.
    """

    def quartiles(cells: DataFrame, keys: list[str]) -> DataFrame:
        """Quartiles by group: the first bins at which the running count reaches 1/4 and 3/4 of the rows."""
        arr = cells.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("rows"))

        def reach(share: int) -> Column:
            start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("bin"))
            step = lambda acc, x: F.struct(
                (acc["sum"] + x["n"]).alias("sum"),
                F.when(acc["bin"].isNull() & (4 * (acc["sum"] + x["n"]) >= share * F.col("rows")), x["bin"]).otherwise(acc["bin"]).alias("bin"),
            )
            return F.aggregate("h", start, step, lambda acc: acc["bin"])

        return arr.select(*keys, "metric", "rows", reach(1).alias("q1"), reach(3).alias("q3"))

    by_source = quartiles(histograms, ["lang", "source"])
    lang_cells = histograms.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    by_lang = quartiles(lang_cells, ["lang"])
    whole = quartiles(lang_cells.groupBy("metric", "bin").agg(F.sum("n").alias("n")), [])
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    l, w = by_lang.select(*[F.col(c).alias(f"l_{c}") for c in by_lang.columns]), whole.select(*[F.col(c).alias(f"w_{c}") for c in whole.columns])
    best = by_source.join(l, same("lang", "l_lang") & (F.col("metric") == F.col("l_metric"))).join(w, F.col("metric") == F.col("w_metric"))

    def drawn(rows: str, own: Column, to: Column) -> Column:
        """``own`` weighted by its rows, and ``to`` by the prior's."""
        return (F.col(rows) * own.cast("double") + F.lit(float(prior)) * to.cast("double")) / (F.col(rows) + F.lit(float(prior)))

    chosen = best.select("lang", "source", "metric", *[drawn("rows", F.col(q), drawn("l_rows", F.col(f"l_{q}"), F.col(f"w_{q}"))).alias(q) for q in ("q1", "q3")])
    limits = []
    for m, (_, lower, least) in METRICS.items():
        mine = F.col("metric") == m
        wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * F.lit(spread)
        limits.append(F.max(F.when(mine, F.col("q3") + wide)).alias(f"high_{m}"))
        limits.append(F.max(F.when(mine, F.col("q1") - wide if lower else F.lit(-1.0))).alias(f"low_{m}"))
    return chosen.groupBy("lang", "source").agg(*limits)


def _within() -> Column:
    """Whether the metrics lie within the fences joined to the row."""
    fits = F.lit(True)
    for m, (e, _, _) in METRICS.items():
        fits = fits & F.coalesce(F.expr(e).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(False))
    return fits


def _fenced(measured: DataFrame, limits: DataFrame) -> DataFrame:
    on = F.col("__lang").eqNullSafe(F.col("lang")) & F.col("__source").eqNullSafe(F.col("source"))
    return measured.join(limits, on, "left").withColumn("kept", ~F.col("base_failed") & _within())


def _grouped(kept: Column, lang: str, source: str) -> list[Column]:
    return [kept.alias("__kept"), F.col(lang).cast("string").alias("__lang"), F.col(source).cast("string").alias("__source")]


def judge(docs: DataFrame, keep: list[Column], *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: int = 100, spread: float = 3.0) -> DataFrame:
    """The columns ``keep``, the counts, ``base_failed`` and ``kept`` of every row.

    The fences are one row a (language, source), joined by value; Spark sends them to the workers if they are few and else
    shuffles the narrow counts.
    """
    measured = save(measure(docs, _grouped(F.struct(*keep), lang_col, source_col), text_col=text_col), "quality-counts")
    limits = fences(sketches(measured, "__lang", "__source"), prior=prior, spread=spread)
    return _fenced(measured, limits).select("__kept.*", *COUNTS, "base_failed", "kept")


def passing(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: int = 100, spread: float = 3.0) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts are counted twice rather than written or shuffled."""
    groups = _grouped(F.lit(None).cast("int"), lang_col, source_col)
    limits = save(fences(sketches(measure(docs, groups, text_col=text_col), "__lang", "__source"), prior=prior, spread=spread), "quality-fences")
    measured = measure(docs, _grouped(F.struct("*"), lang_col, source_col), text_col=text_col)
    lost = F.col("base_failed").cast("int") + (~F.col("kept")).cast("int")  # one sum, so that no part is pushed below the counts
    return _fenced(measured, limits).where(lost == 0).select("__kept.*")
