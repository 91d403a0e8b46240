"""Mixing a corpus to target weights by iterative proportional fitting.

Token weights are summed by cell, one cell for each combination of the margin columns that occurs. A round scales the cells
once for each margin, so that the margin's sums meet its targets; ``rounds`` rounds bring the margins as close as they get in
so many (eight leave 1e-9 of a share where margins are as mild as the queries'). A cell's
sampling probability is its fitted weight over its tokens, times the largest factor that keeps every probability at most 1,
times ``rate``. A document is drawn if a hash of its id, uniform in 0..1, lies below its cell's probability, so draws repeat
exactly and do not depend on partitions.

Only cells are fitted: a step sums the weights of a margin's values, in part before the shuffle, and keeps one factor a value;
a cell's weight is its tokens times the factors of its values. The documents are read twice, once to be summed likewise and
once to be joined with their cell. A topic is learned where a corpus has none: of the words that at most a tenth of the documents
have, the commonest ones stand for topics, and a document has the topic whose word it has most often.

Null margin values form a category ``''`` of their own and null texts weigh 0 tokens. Cells without tokens get probability 1.
Targets for values that do not occur are ignored, values without a target share what the others leave by their tokens.
Repeated rows are drawn together, as are all rows with a null id, whose hash counts as 0, so they are always drawn. Of topics
that tie, the commoner word's counts; documents without any have the topic ``other``. A text of any length is one row's work. An
empty table gives an empty result; other columns are kept or ignored as asked.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.durable import save

GAPS = r"[\x20\x09-\x0D]+"


def token_weight(text: Column) -> Column:
    """Words of a text: runs outside the six ASCII blanks."""
    return F.coalesce(F.size(F.array_remove(F.split(text, GAPS), "")), F.lit(0)).cast("bigint")


TOPICS = 16


def words_of(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def topic_words(texts: DataFrame, *, text_col: str = "text", topics: int = TOPICS) -> list[str]:
    """The ``topics`` words that most documents have, of those that at most a tenth have; of equals the first in order."""
    each = texts.select(F.explode(F.array_distinct(words_of(F.col(text_col)))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    most = texts.count() / 10
    return [r.w for r in each.where(F.col("n") <= most).orderBy(F.desc("n"), "w").limit(topics).collect()]


def topic_of(text: Column, topics: list[str]) -> Column:
    """The topic word that is most often among the words of ``text``, the first of equals, or ``other``."""
    if not topics:
        return F.lit("other")
    words = "|".join(re.escape(t) for t in sorted(topics, key=len, reverse=True))
    held = F.regexp_extract_all(text, F.lit(rf"(?:^|[\x20\x09-\x0D])({words})(?![^\x20\x09-\x0D])"), F.lit(1))
    of = lambda hits: F.array_max(F.transform(F.lit(topics), lambda t, i: F.struct(F.size(F.filter(hits, lambda h: h == t)).alias("n"), (-i).alias("first"), t.alias("t"))))
    best = F.get(F.transform(F.array(held), of), F.lit(0))
    return F.when(best["n"] > 0, best["t"]).otherwise("other")


def with_topics(docs: DataFrame, keep: list[Column], *, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, ``topic`` and ``n_tokens`` of every row."""
    topics = topic_words(docs, text_col=text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct(*keep).alias("__keep"), topic_of(text, topics).alias("topic"), token_weight(F.col(text_col)).alias("n_tokens")).select("__keep.*", "topic", "n_tokens")


def tempered_targets(cells: DataFrame, dims: list[str], power: float) -> DataFrame:
    """``dim``, ``value``, ``share``: each margin's token shares raised to ``power`` and made to sum to 1."""
    out = None
    for d in dims:
        mine = cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("raw"))
        out = mine if out is None else out.unionByName(mine)
    return out.withColumn("share", F.col("raw") / F.sum("raw").over(Window.partitionBy("dim"))).drop("raw")


def fixed_targets(cells: DataFrame, dims: list[str], shares: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """The same table from given shares by margin and value."""
    spark = cells.sparkSession
    rows = [(d, v, float(s)) for d, by in shares.items() for v, s in by.items()]
    given = spark.createDataFrame(rows, "dim string, value string, asked double")
    out = None
    for d in dims:
        mine = cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
        out = mine if out is None else out.unionByName(mine)
    w = Window.partitionBy("dim")
    joined = out.join(given, ["dim", "value"], "left").withColumn("left", F.greatest(1 - F.coalesce(F.sum("asked").over(w), F.lit(0.0)), F.lit(0.0)))
    rest = F.sum(F.when(F.col("asked").isNull(), F.col("tokens"))).over(w)
    raw = F.coalesce("asked", F.coalesce(F.try_divide(F.col("left") * F.col("tokens"), rest), F.lit(0.0)))
    return joined.withColumn("raw", raw).select("dim", "value", (F.col("raw") / F.sum("raw").over(w)).alias("share"))


def rake(cells: DataFrame, dims: list[str], targets: DataFrame, rounds: int) -> DataFrame:
    """The cells with ``weight``, fitted in ``rounds`` rounds; weights sum to 1 once the margins agree.

    A step multiplies the factors of the other margins into the cells' tokens, sums them by value and sets each value's factor
    to what meets its share.
    """
    factors: dict[str, DataFrame] = {}

    def weighed(but: str | None = None) -> DataFrame:
        rows, weight = cells, F.col("tokens").cast("double")
        for d in dims:
            if d != but and d in factors:
                rows, weight = rows.join(factors[d].withColumnRenamed("factor", f"__{d}"), d), weight * F.col(f"__{d}")
        return rows.select(*cells.columns, weight.alias("weight"))

    for _ in range(rounds):
        for d in dims:
            share = targets.where(F.col("dim") == d).select(F.col("value").alias(d), "share")
            sums = weighed(d).groupBy(d).agg(F.sum("weight").alias("sum")).join(share, d)
            factors[d] = save(sums.select(d, F.coalesce(F.try_divide("share", "sum"), F.lit(0.0)).alias("factor")), f"mix-{d}")
    return weighed()


def probabilities(fitted: DataFrame, rate: float) -> DataFrame:
    """The cells with ``probability``, the largest of them ``rate``, and ``weight`` as a multiple of the natural share."""
    ratio = F.try_divide(F.col("weight"), F.col("tokens"))
    whole = fitted.agg(F.max(ratio).alias("top"), F.sum("tokens").alias("tokens"))
    top, tokens = whole.select("top").scalar(), whole.select("tokens").scalar()
    with_p = fitted.withColumn("probability", F.coalesce(F.round(F.lit(rate) * F.try_divide(ratio, top), 9), F.lit(1.0)))
    return with_p.withColumn("weight", F.round(F.coalesce(ratio * tokens, F.lit(0.0)), 9))


def unit_hash(id_: Column, seed: str) -> Column:
    """A number in 0..1 from an id: the first 52 bits of a digest."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), id_.cast("string")), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(
    docs: DataFrame,
    dims: list[str],
    *,
    id_col: str = "doc_id",
    tokens_col: str = "n_tokens",
    targets: Mapping[str, Mapping[str, float]] | None = None,
    power: float = 0.7,
    rounds: int = 8,
    rate: float = 1.0,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with ``weight`` (a token's multiple of its natural share), ``probability`` and ``selected``.

    ``docs`` has the margin columns ``dims`` as strings and the tokens of each row. ``targets`` gives shares by margin and
    value; without it they are the present shares raised to ``power``, which lifts what is rare.
    """
    named = docs
    for d in dims:
        named = named.withColumn(d, F.coalesce(F.col(d), F.lit("")))
    cells = save(named.groupBy(*dims).agg(F.sum(tokens_col).cast("bigint").alias("tokens")), "mix-cells")
    wanted = tempered_targets(cells, dims, power) if targets is None else fixed_targets(cells, dims, targets)
    fitted = probabilities(save(rake(cells, dims, save(wanted, "mix-targets"), rounds), "mix-raked"), rate)
    table = save(fitted.select(*[F.col(d).alias(f"__{d}") for d in dims], "weight", "probability"), "mix-fitted")
    on = [F.coalesce(F.col(d), F.lit("")) == F.col(f"__{d}") for d in dims]
    out = docs.join(table, on, "left").drop(*[f"__{d}" for d in dims])
    return out.withColumn("selected", F.coalesce(unit_hash(F.col(id_col), seed), F.lit(0.0)) < F.col("probability"))


def drawn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` that are drawn for tempered source, language and topic margins, with their columns."""
    margins = [F.struct("*").alias("__doc"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang")]
    return mix(with_topics(docs, margins, text_col=text_col), ["source", "lang", "topic"], **how).where("selected").select("__doc.*")
