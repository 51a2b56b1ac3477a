"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, let, small_enough, words_spaced

MIN_WORDS = 50
#: Ratio: (share of one event in a document, how many of them are one oddity, whether low values are odd too). One symbol,
#: one repeated line, two copies of eight words; one character more or less in a document.
RATIOS = {
    "symbols_per_word": ("per_word", 1, False),
    "dup_line_share": ("per_line", 1, False),
    "repeat_share": ("per_word", 16, False),
    "mean_word": ("per_word", 1, True),
}
#: Fences stand so many spreads outside the quartiles. A spread is what the inner half of the group's values spans, or one
#: oddity in the group's median document, if that is more, as a ratio can't be told finer.
REACH = 5.0
#: Documents that the language's distribution counts for in each of its sources, and that of all in each language.
PRIOR = 200
#: Bins of a sketch grow by this factor, so a quantile is told within 1 %; values under LEAST are one bin with zero.
GROWTH = 1.02
LEAST = 1e-6
_UNIT = 1_000_000
BROADCAST_GROUPS = 20_000


def _repeated_words(words: Column) -> Column:
    """Words covered by three-word windows whose text occurs at least twice in the same text.

    Window hashes are sorted together with their places: the hash's upper bits and the place share one long, so equal
    windows become neighbours in one primitive sort. Neighbours are compared by the whole hash. n log n for any text.
    """

    def count(w: Column) -> Column:
        n = F.size(w) - 2
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, n)

        def places(h: Column) -> Column:
            bits = F.length(F.bin(n.cast("long")))
            packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))
            low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            place = lambda k: k.bitwiseAND(low).cast("int")
            at = lambda p, j: F.get(h, place(F.get(p, j)))  # noqa: E731  null beyond the last
            same = lambda p, k, j: F.coalesce(F.get(h, place(k)) == at(p, j + 1), F.lit(False)) | ((j > 0) & (F.get(h, place(k)) == at(p, F.greatest(j - 1, F.lit(0)))))
            twice = lambda p: F.transform(p, lambda k, j: F.when(same(p, k, j), place(k)))
            found = F.array_compact(let(packed, twice))
            return F.size(F.array_distinct(F.flatten(F.transform(found, lambda p: F.array(p, p + 1, p + 2)))))

        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(places(h)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(count(words)).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each row; null text counts as the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = let(words_spaced(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    dup = let(lines, lambda a: F.struct(F.size(a).alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).alias("n_dup")))
    return docs.select("doc_id", "lang", "source", measured.alias("m"), dup.alias("l"), F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols")).select(
        "doc_id", "lang", "source", "m.n_words", "word_chars", "n_symbols", F.col("l.n_dup").cast("long").alias("n_dup_lines"), "m.n_repeat_words", F.col("l.n_lines").cast("long").alias("n_lines")
    )


def _ratios(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({"symbols_per_word": F.col("n_symbols") / n, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / n, "mean_word": F.col("word_chars") / n, "per_word": 1 / n, "per_line": 1 / F.greatest(F.col("n_lines"), F.lit(1))})


def _bin(value: Column) -> Column:
    return F.when(value < LEAST, F.lit(None).cast("int")).otherwise(F.ceil(F.log(value) / F.log(F.lit(GROWTH))).cast("int"))


def _edge(bin_: Column, upper: bool) -> Column:
    """The end of a bin; the bin of zero ends at zero, so values that all are zero have no spread."""
    return F.coalesce(F.pow(F.lit(GROWTH), bin_.cast("double") - (0 if upper else 1)), F.lit(0.0))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, bin, n): a quantile sketch of each ratio per language and source, as counts of logarithmic bins,
    and of the shares that one word and one line have in a document.

    Sketches merge by adding counts, so they are partial aggregates, the same in every run. A ratio has a few thousand
    bins at most, whatever the rows. Null is the bin of zero.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("ratio"), _bin(F.col(c)).alias("bin")) for c in (*RATIOS, "per_word", "per_line")])).alias("b")
    return measured.select("lang", "source", pairs).groupBy("lang", "source", "b.ratio", "b.bin").agg(F.count("*").alias("n"))


def fences(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source): a low and a high fence for each ratio.

    A group's quartiles are those of its own sketch and, as ``prior`` more documents, its language's; the language's
    has, as ``prior`` more, that of all. So small groups lean on the larger ones by one rule for every size.
    """
    own = cut(sketches(measured))
    langs = own.groupBy("lang", "ratio", "bin").agg(F.sum("n").alias("n"))
    every = own.groupBy("ratio", "bin").agg(F.sum("n").alias("n"))
    total = every.groupBy("ratio").agg(F.sum("n").alias("n_all"))
    sizes = langs.groupBy(F.col("lang").alias("_lang"), F.col("ratio").alias("_ratio")).agg(F.sum("n").alias("n_lang"))
    groups = own.select("lang", "source", "ratio").distinct().join(F.broadcast(sizes) if small_enough(sizes, BROADCAST_GROUPS) else sizes, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("ratio") == F.col("_ratio"))).drop("_lang", "_ratio")
    whole = lambda w: F.round(w * _UNIT).cast("long").alias("w")  # noqa: E731  integers, so that sums don't depend on their order
    lead = ["lang", "source", "ratio"]
    upper = langs.withColumnsRenamed({"lang": "_lang", "ratio": "_ratio"})
    from_lang = groups.join(upper, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("ratio") == F.col("_ratio"))).select(*lead, "bin", whole(prior * F.col("n") / (F.col("n_lang") + prior)))
    from_all = groups.join(F.broadcast(every.join(total, "ratio")), "ratio").select(*lead, "bin", whole(F.lit(float(prior) * prior) * F.col("n") / F.col("n_all") / (F.col("n_lang") + prior)))
    joint = own.select(*lead, "bin", (F.col("n") * _UNIT).alias("w")).union(from_lang).union(from_all).groupBy(*lead, "bin").agg(F.sum("w").alias("w"))
    bins = Window.partitionBy(*lead)  # a sketch's bins, bounded
    upto = joint.withColumn("upto", F.sum("w").over(bins.orderBy(F.col("bin").asc_nulls_first()))).withColumn("share", F.col("upto") / F.sum("w").over(bins))
    at = lambda q, upper: F.min(F.when(F.col("share") >= q, _edge(F.col("bin"), upper)))
    quartiles = upto.groupBy(*lead).agg(at(0.25, False).alias("q1"), at(0.5, True).alias("q2"), at(0.75, True).alias("q3"))
    of = lambda name, x: F.max(F.when(F.col("ratio") == name, F.col(x)))
    out = []
    for c, (event, times, low) in RATIOS.items():
        reach = F.lit(REACH) * F.greatest(of(c, "q3") - of(c, "q1"), times * of(event, "q2"))
        out += [(of(c, "q3") + reach).alias(f"{c}_high"), *([(of(c, "q1") - reach).alias(f"{c}_low")] if low else [])]
    return quartiles.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept per row of ``docs``.

    Base: fewer than 50 words, or over half of the words in three-word windows that occur twice. Of the others, those
    whose symbols per word, share of repeated lines, share of repeated words or mean word length lie beyond the fences
    of their language and source fail too. Only documents that pass the base make sketches. Null languages and sources
    are groups of their own. Null text counts as the empty text, which fails the base. Very long texts count whole;
    repeated rows count each. A ratio on its fence is inside. An empty table gives no rows. Reruns agree.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = cut(_ratios(counts(docs)).withColumn("base_failed", failed))
    limits = fences(measured.where(~F.col("base_failed")), prior).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    if small_enough(limits, BROADCAST_GROUPS):
        limits = F.broadcast(limits)
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = reduce(lambda a, b: a & b, [F.col(c) <= F.col(f"{c}_high") for c in RATIOS] + [F.col(c) >= F.col(f"{c}_low") for c, (*_, low) in RATIOS.items() if low])
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))
