"""Operator 2: benchmark decontamination with a positional inverted index.  DataFrame functions only.

1. Benchmark items are cut into windows of ``width`` words; equal items are one.
2. Document frequencies of the benchmark's words over all training documents show
   each window's rarest words, its anchors; a window with a word that no document has
   is dropped.
3. The index holds the postings (word, document, position) of the anchors.  Each
   posting meets the places where an item has its word, and those of one document and
   item are gathered in overlapping bands of ``BAND`` positions.
4. Where all anchors of a window agree on a start (their positions less their offsets),
   that start is a candidate for an exact match; where all stand in a band in any
   order, the band is one for a proximity match.
5. Candidates are held against the document's own words: an exact match is the window
   word for word, a proximity match a stretch of at most its length and ``slop`` words
   more that holds every word of it.

The benchmark is broadcast only if its size was checked; beyond the limit Spark
shuffles, and a word's postings are dealt to ``SALTS`` parts.  Documents are known by a
hash of doc_id and text and items by one of their words, so repeated rows and null ids
are judged each for itself, and a collision cannot make a false match.

Defined results: null or empty text has no words, no hits and is clean; items
without words have no windows; an empty benchmark leaves all documents clean;
further columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.sized import small
from quern.scratch import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of a lower-cased text.  Splitting is far cheaper in Spark than extracting matches.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 3
#: Positions from which a proximity match may start in a band; a band reaches as far again.
BAND = 32
SLOP = 5
SALTS = 16


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return words_of(lowered(text))


def words_of(low: Column) -> Column:
    """Words of a lower-cased text."""
    return F.array_remove(F.split(low, BETWEEN), "")


def windows(items: DataFrame, width: int) -> DataFrame:
    """(iid, items, j, words): windows of distinct items, j where each starts, items the ids (as strings) that share it."""
    cut = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    whole = cut.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("iid", F.xxhash64(F.array_join("w", " ")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return whole.select("iid", "items", "w", F.explode(starts).alias("j")).select("iid", "items", "j", F.slice("w", F.col("j") + 1, F.lit(width)).alias("words"))


def keyed(documents: DataFrame) -> DataFrame:
    """(k, text)."""
    return documents.select(F.xxhash64("doc_id", "text").alias("k"), "text")


def anchors(documents: DataFrame, phrases: DataFrame, count: int = ANCHORS) -> DataFrame:
    """(iid, j, word, off): the rarest words of each window that can occur at all, and their places in the item."""
    spelled = phrases.select("iid", "j", F.posexplode("words").alias("o", "word"))
    vocabulary = small(spelled.select("word").distinct())
    tokens = documents.select(F.explode(words(F.col("text"))).alias("word"))
    frequency = materialize(tokens.join(vocabulary, "word").groupBy("word").count(), "frequency")
    ranked = spelled.join(small(frequency), "word", "left")
    window = Window.partitionBy("iid", "j")
    ranked = ranked.withColumn("missing", F.max(F.col("count").isNull()).over(window)).where("not missing")
    ranked = ranked.withColumn("rank", F.row_number().over(window.orderBy("count", "o"))).where(F.col("rank") <= count)
    found = materialize(ranked.select("iid", "j", "word", (F.col("j") + F.col("o")).alias("off")), "anchors")
    discard(frequency)
    return found


def index(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, k, pos): postings of the vocabulary's words in all documents, as a written table."""
    tokens = keyed(documents).select("k", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return materialize(tokens.join(small(vocabulary), "word").select("word", "k", "pos"), "postings")


def _met(postings: DataFrame, places: DataFrame) -> DataFrame:
    """Postings beside the places of their words; without a broadcast a hot word's postings are dealt to several tasks."""
    held = small(places)
    if held is not places:
        return postings.join(held, "word")
    salted = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", F.pmod("k", F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"]).drop("salt")


def candidates(postings: DataFrame, rare: DataFrame, phrases: DataFrame) -> DataFrame:
    """(k, items, words, starts, from): windows whose anchors meet in a band, with the starts that these agree on."""
    fewest = rare.groupBy("iid", "j").count().groupBy("iid").agg(F.min("count").cast("int").alias("fewest"))
    places = rare.select("iid", "word", "off").distinct().join(fewest, "iid")
    block = F.floor(F.col("pos") / BAND).cast("int")
    bands = F.explode(F.when(block > 0, F.array(block, block - 1)).otherwise(F.array(block)))
    rows = _met(postings, places).select("k", "iid", "fewest", bands.alias("band"), F.struct(F.col("off").alias("off"), F.col("pos").alias("pos")).alias("at"))
    groups = rows.groupBy("k", "iid", "band", "fewest").agg(F.collect_set("at").alias("at")).where(F.size("at") >= F.col("fewest"))
    offs = rare.groupBy("iid", "j").agg(F.collect_set("off").alias("offs"))
    held = phrases.join(offs, ["iid", "j"]).groupBy("iid").agg(F.collect_list(F.struct("j", "offs", "words", "items")).alias("windows"))
    groups = groups.join(small(held), "iid")
    present = groups.withColumn("have", F.col("at.off"))
    met = present.select("k", "band", "at", F.explode(F.filter("windows", lambda x: F.size(F.array_except(x["offs"], F.col("have"))) == 0)).alias("x"))
    # the first anchor's positions give starts, which the other anchors confirm
    first = F.transform(F.filter("at", lambda a: a["off"] == F.col("x.offs")[0]), lambda a: a["pos"] - a["off"] + F.col("x.j"))
    agreed = F.filter(first, lambda t: (t >= 0) & F.forall("x.offs", lambda o: F.array_contains(F.col("at"), F.struct(o.alias("off"), (t + o - F.col("x.j")).alias("pos")))))
    return met.select("k", F.col("x.items").alias("items"), F.col("x.words").alias("words"), agreed.alias("starts"), (F.col("band") * BAND).alias("from"))


def judged(documents: DataFrame, items: DataFrame, width: int = 13, share: int = 20, slop: int = SLOP) -> DataFrame:
    """(row, n_words, n_hit, n_items, items, near, contaminated): row is the document with all its columns.

    Items occur word for word, near ones by a proximity match.  Contaminated: hit words are at least one in ``share``
    of all words.
    """
    if width + slop > BAND:
        raise ValueError(f"a window and its slop must fit into {BAND} words")
    phrases = materialize(windows(items, width), "phrases")
    rare = anchors(documents, phrases)
    postings = index(documents, rare.select("word").distinct())
    met = candidates(postings, rare, phrases).groupBy("k").agg(F.collect_list(F.struct("starts", "from", "words", "items")).alias("met"))
    met = materialize(met, "candidates")
    discard(postings, rare, phrases)
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    rows = rows.withColumn("k", F.xxhash64("row.doc_id", "row.text")).join(met, "k", "left").withColumn("w", words(F.col("row.text")))
    held = F.coalesce("met", F.array())
    exact = F.transform(held, lambda c: F.struct(F.filter(c["starts"], lambda t: F.slice(F.col("w"), t + 1, F.size(c["words"])) == c["words"]).alias("starts"), F.size(c["words"]).alias("n"), c["items"].alias("items")))
    exact = F.filter(exact, lambda c: F.size(c["starts"]) > 0)
    near = F.filter(held, lambda c: F.exists(F.sequence(c["from"], c["from"] + BAND - 1), lambda t: F.size(F.array_except(c["words"], F.slice(F.col("w"), t + 1, F.size(c["words"]) + slop))) == 0))
    rows = rows.select("row", F.size("w").alias("n_words"), F.when(F.col("met").isNotNull(), exact).alias("hits"), F.when(F.col("met").isNotNull(), near["items"]).alias("around"))
    places = F.flatten(F.transform("hits", lambda c: F.flatten(F.transform(c["starts"], lambda t: F.sequence(t, t + c["n"] - 1)))))
    rows = rows.withColumn("n_hit", F.coalesce(F.size(F.array_distinct(places)), F.lit(0)))
    names = lambda c: F.coalesce(F.array_sort(F.array_distinct(F.flatten(c))), F.array().cast("array<string>"))
    rows = rows.withColumns({"items": names(F.col("hits.items")), "near": names(F.col("around"))})
    return rows.select("row", "n_words", "n_hit", F.size("items").alias("n_items"), "items", "near", ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def contamination(documents: DataFrame, items: DataFrame, width: int = 13, share: int = 20, slop: int = SLOP) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_items_sha256) per document."""
    out = judged(documents.select("doc_id", "text"), items, width, share, slop)
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return out.select(
        "row.doc_id", *(F.col(c).cast("long") for c in ("n_words", "n_hit", "n_items")), digest("items").alias("items_sha256"), "contaminated",
        F.size("near").cast("long").alias("n_near"), digest("near").alias("near_items_sha256"),
    )


def keep_clean(documents: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return judged(documents, items, width, share).where("not contaminated").select("row.*")
