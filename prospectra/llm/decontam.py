"""Benchmark decontamination by winnowed fingerprints, extended to whole windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_ids, cut, let, lower_ascii, small_enough

#: Words of the shortest shared span that must be found, and of a k-gram; the window of k-grams follows from them.
SPAN = 10
GRAM = 5
#: A benchmark with at most so many fingerprints (about 40 bytes each) is sent to all executors; beyond it, both sides are shuffled.
BROADCAST_FINGERPRINTS = 200_000
_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _DELIMITERS), "")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _grams(hashes: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words; ``hashes`` must be bound, as every element looks at its neighbours."""
    count = F.size(hashes) - (n - 1)
    all_grams = F.transform(hashes, lambda x, i: F.xxhash64(F.lit(n), x, *[F.get(hashes, i + j) for j in range(1, n)]))
    return F.when(count > 0, F.slice(all_grams, 1, F.greatest(count, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def _located(grams: Column) -> Column:
    return F.transform(grams, lambda g, i: F.struct(g.alias("fp"), i.alias("pos")))


def _winnowed(hashes: Column, span: int, gram: int) -> Column:
    """(fp, pos) of the k-grams that are least in a window of ``span - gram + 1``; ties are all kept.

    A span of ``span`` equal words holds one whole window on either side, with the same least hash. A gram is the least
    of some window exactly if it equals the greatest of the minima of the windows that it stands in.
    """
    width = span - gram + 1

    def choose(grams: Column) -> Column:
        # null beyond the last whole window
        least = F.transform(grams, lambda g, i: F.when(i <= F.size(grams) - width, F.least(g, *[F.get(grams, i + j) for j in range(1, width)])))
        chosen = let(least, lambda m: F.transform(grams, lambda g, i: F.when(g == F.greatest(*[F.get(m, i - j) for j in range(width)]), F.struct(g.alias("fp"), i.alias("pos")))))
        return F.filter(chosen, lambda x: x.isNotNull())

    empty = F.array().cast("array<struct<fp:bigint,pos:int>>")
    return F.when(F.size(hashes) >= span, let(_grams(hashes, gram), choose)).otherwise(empty)


def _fingerprints(hashes: Column, span: int, gram: int, short: list[int], item: bool) -> Column:
    """Of an item: winnowed, or the whole where it is shorter than a span. Of a document: both kinds."""
    parts = [_winnowed(hashes, span, gram)]
    for n in short:
        whole = _located(_grams(hashes, n))
        # the length in the hash keeps whole short items apart from k-grams, except at length ``gram``, where both mean the same words
        parts.append(F.when(F.size(hashes) == n, whole).otherwise(F.array().cast("array<struct<fp:bigint,pos:int>>")) if item else whole)
    return F.array_distinct(F.concat(*parts)) if len(parts) > 1 else parts[0]


def _windows_at(hashes: Column, starts: Column, n: int) -> Column:
    """(n, win, at): the hash of the ``n`` words from each of ``starts`` on, without those that reach beyond the text."""
    inside = F.filter(starts, lambda s: (s >= 0) & (s + n <= F.size(hashes)))
    return F.transform(inside, lambda s: F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), *[F.get(hashes, s + j) for j in range(n)]).alias("win"), s.alias("at")))


def _few(rows: DataFrame) -> DataFrame:
    rows = cut(rows)
    return F.broadcast(rows) if small_enough(rows, BROADCAST_FINGERPRINTS) else rows


def find_hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(hits, windows). hits (_id, _mark, n, win, at): each window of a document that some item holds too, and where it is.

    Fingerprints of documents and items meet in an equi-join. Each place where they meet is extended to the windows of
    ``span`` words (a short item: all of it) around it, whose hashes meet those of the items' windows. Only documents
    that meet an item are read again; their texts aren't shuffled unless they are very many. What a document gathers
    are its own places, so repeated words cost what they count, once. ``windows`` (n, win, item) tell the items.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _hashes(F.col("text")).alias("words"))
    items = cut(items.where(F.size("words") > 0).distinct())
    short = sorted(r[0] for r in items.where(F.size("words") < span).select(F.size("words")).distinct().collect())
    lengths = [*short, span]
    marks = _few(items.select(F.explode(let(F.col("words"), lambda h: _fingerprints(h, span, gram, short, True))).alias("f")).select("f.fp").distinct())
    whole = lambda n: F.when((F.size("words") == n) if n < span else (F.size("words") >= n), _windows_at(F.col("words"), F.sequence(F.lit(0), F.size("words") - n), n)).otherwise(F.array().cast("array<struct<n:int,win:bigint,at:int>>"))
    windows = cut(items.select("item", F.explode(F.concat(*[whole(n) for n in lengths])).alias("w")).select("item", "w.n", "w.win").distinct())
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"), "text")
    # explode_outer: before an explode Spark would filter by the whole expression, so evaluate it again
    seen = keyed.select("_id", "_mark", F.explode_outer(let(_hashes(F.col("text")), lambda h: _fingerprints(h, span, gram, short, False))).alias("f")).select("_id", "_mark", "f.fp", "f.pos")
    places = cut(seen.join(marks, "fp").groupBy("_id", "_mark").agg(F.collect_set("pos").alias("places")))
    met = keyed.join(broadcast_ids(places.withColumnsRenamed({"_id": "_id2", "_mark": "_mark2"}), 4 * F.size("places")), (F.col("_mark") == F.col("_mark2")) & F.col("_id").eqNullSafe(F.col("_id2"))).dropDuplicates(["_id", "_mark"])
    # a window holds the place's k-gram; a short item begins at its place
    around = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p - (span - gram), p))))
    mine = let(_hashes(F.col("text")), lambda h: F.concat(_windows_at(h, around, span), *[_windows_at(h, F.col("places"), n) for n in short]))
    found = met.select("_id", "_mark", F.explode_outer(mine).alias("w")).select("_id", "_mark", "w.*").join(_few(windows.select("n", "win").distinct()), ["n", "win"])
    return found, windows


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters from U+0080. Null text has no words. An
    empty benchmark or one of null texts hits nothing. Benchmark rows that repeat an id count as one item; a null id
    counts as the empty text. Rows of ``docs`` that repeat are judged alike. Very long and repetitive texts count whole,
    in time that grows with their words. Grams of equal hash are all fingerprints. An empty table gives no rows.
    """
    hits, windows = find_hits(docs, benchmark, span, gram)
    hits, key = cut(hits), ["_id", "_mark"]
    # a document's places count once, however many items hold them
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))
    places = hits.groupBy(*key).agg(F.size(covered).cast("long").alias("n_hit"))
    held = hits.select(*key, "n", "win").distinct().join(F.broadcast(windows) if small_enough(windows, BROADCAST_FINGERPRINTS) else windows, ["n", "win"]).select(*key, "item").distinct().groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = places.join(held.withColumnsRenamed({"_id": "_id2", "_mark": "_mark2"}), (F.col("_mark") == F.col("_mark2")) & F.col("_id").eqNullSafe(F.col("_id2"))).drop("_id2", "_mark2")
    found = broadcast_ids(cut(both), F.octet_length(F.array_join("items", ",")))
    counts = docs.select("doc_id", F.xxhash64("text").alias("_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = counts.join(found, (F.col("_key") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` without any window of ``benchmark``; columns unchanged, whatever their names."""
    found = broadcast_ids(cut(find_hits(docs, benchmark, span, gram)[0].select("_id", "_mark").distinct()))
    return docs.join(found, (F.xxhash64(docs.text) == found["_mark"]) & docs.doc_id.eqNullSafe(found["_id"]), "left_anti")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM iw WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM ip),
ns AS (SELECT DISTINCT n FROM ig),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw JOIN ns ON len(w) >= n),
dg AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM dp),
m AS (SELECT doc_id, p, dg.n, item_id FROM dg JOIN ig ON dg.g = ig.g AND dg.n = ig.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN i ON dw.doc_id = i.doc_id
"""
