"""Benchmark decontamination with a distributed positional inverted index.

DataFrame functions only. One pass over the training texts stores the postings
(term, document, position) of all terms that occur in some test item, and each
document's number of words. A test item's windows of ``width`` words are then
found by intersecting offset-adjusted posting lists, rarest terms first: a
posting of the item's term at item position i puts the item on the diagonal
position - i of the document. The lists of each window's two rarest terms
(by the index's own counts) are intersected on the diagonal; only diagonals
that survive meet the postings of the item's other terms, and a window occurs
where all its terms lie on one diagonal.

The test vocabulary is broadcast while its text has ``VOCABULARY_BYTES`` at most;
a larger one joins by shuffle. Postings of a very frequent term are spread over
the index's files, joins on term have the (small) test side broadcast under the
same rule, and all other keys contain the document.

Words: runs of digits, a-z and anything beyond ASCII, after A-Z became a-z.
Defined results: a null text has no words; an item without words has no
windows, one of fewer than ``width`` words is a single window; repeated items
are found alike, and an item id counts once; repeated documents each get their
row. A document is known by a 64-bit hash of id and text. Other columns are
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareshift.llm.common import materialize, small_side

WIDTH = 10
VOCABULARY_BYTES = 32 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Fixed value: what separates words.
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(low, _SEPARATOR), "")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, at, len, term) of every item word, and the vocabulary (word, term). ``item`` is a
    hash of id and text, so that rows sharing an id stay apart."""
    words = (items.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("item"), F.col(id_col).alias("item_id"),
                          words_of(F.col(text_col)).alias("w")).distinct()
             .select("item", "item_id", F.size("w").alias("len"), F.posexplode("w").alias("at", "word")))
    words = materialize(words, "decontam-items")
    vocabulary = materialize(words.select("word").distinct().withColumn("term", F.xxhash64("word")),
                             "decontam-vocabulary")
    return words.withColumn("term", F.xxhash64("word")).drop("word"), vocabulary


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Postings (term, doc, pos) of the vocabulary's terms, and (doc, id, n_words) of every row."""
    size = vocabulary.agg(F.sum(F.octet_length("word") + 24)).first()[0] or 0
    known = vocabulary.union(docs.sparkSession.createDataFrame([("", None)], vocabulary.schema))
    known = F.broadcast(known) if size <= VOCABULARY_BYTES else known
    # The empty word closes each document: its position is the number of words.
    tokens = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc"),
                         F.posexplode(F.concat(words_of(F.col(text_col)), F.array(F.lit("")))).alias("pos", "word"))
    stored = materialize(tokens.join(known, "word").select(
        "term", "doc", "pos", F.when(F.col("term").isNull(), F.col("id")).alias("id")), "decontam-index")
    ends = stored.where("term is null").select("doc", "id", F.col("pos").cast("long").alias("n_words"))
    return stored.where("term is not null").select("term", "doc", "pos"), ends


def rare_pairs(terms: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """Per window its start and length, and the item positions and terms of its two rarest words
    (a window of one word has it twice)."""
    freq = index.groupBy("term").agg(F.count("*").alias("freq"))
    ranked = terms.join(freq, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))
    starts = terms.groupBy("item", "len").agg(F.min("at").alias("_")).select(
        "item", F.least("len", F.lit(width)).alias("n"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.col("len") - width, F.lit(0)))).alias("start"))
    within = (starts.join(ranked, "item").where("at >= start and at < start + n")
              .groupBy("item", "start", "n")
              .agg(F.sort_array(F.collect_list(F.struct("freq", "at", "term"))).alias("t")))
    # An absent word rules its window out at once.
    return within.where(F.col("t")[0]["freq"] > 0).select(
        "item", "start", "n", F.col("t")[0]["at"].alias("at1"), F.col("t")[0]["term"].alias("term1"),
        F.try_element_at("t", F.lit(2))["at"].alias("at2"), F.try_element_at("t", F.lit(2))["term"].alias("term2")) \
        .withColumn("at2", F.coalesce("at2", "at1")).withColumn("term2", F.coalesce("term2", "term1"))


def _lists(index: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Offset-adjusted lists: (item, doc, diagonal, at) of the wanted (item, at, term)."""
    return index.join(small_side(materialize(wanted.distinct(), f"decontam-wanted{n}")), "term") \
        .withColumn("diagonal", F.col("pos") - F.col("at"))


def occurrences(index: DataFrame, terms: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, item, start, n): every place (word position) where a window of an item occurs."""
    windows = materialize(rare_pairs(terms, index, width), "decontam-windows")
    first = _lists(index, windows.select("item", F.col("at1").alias("at"), "at2", F.col("term1").alias("term")), 1)
    second = _lists(index, windows.select("item", F.col("at2").alias("at"), F.col("term2").alias("term")), 2)
    first = first.select("item", "doc", "diagonal", "at2")
    second = second.select("item", "doc", "diagonal", F.col("at").alias("at2"))
    found = materialize(first.join(second, ["item", "doc", "diagonal", "at2"], "left_semi")
                        .select("item", "doc", "diagonal").distinct(), "decontam-diagonals")
    docs = materialize(found.select("doc").distinct(), "decontam-docs")
    others = (index.join(small_side(docs), "doc", "left_semi")
              .join(small_side(materialize(terms.select("item", "at", "term").distinct(), "decontam-terms")), "term")
              .withColumn("diagonal", F.col("pos") - F.col("at")))
    lines = (others.join(found, ["item", "doc", "diagonal"], "left_semi")
             .groupBy("item", "doc", "diagonal").agg(F.collect_set("at").alias("ats")))
    spans = windows.groupBy("item").agg(F.collect_set(F.struct("start", "n")).alias("ws"))
    whole = F.filter("ws", lambda w: F.size(F.array_intersect(
        F.col("ats"), F.sequence(w["start"], w["start"] + w["n"] - 1))) == w["n"])
    return (lines.join(spans, "item").select("doc", "item", "diagonal", F.explode(whole).alias("w"))
            .select("doc", "item", (F.col("diagonal") + F.col("w.start")).alias("start"), F.col("w.n").alias("n")))


def proximity_matches(index: DataFrame, terms: DataFrame, width: int = WIDTH, slop: int = 3) -> DataFrame:
    """(doc, item, start): windows whose two rarest words occur in a document in the item's order with
    a distance that is off by 1 to ``slop`` words; ``start`` is where the first one puts the window."""
    windows = rare_pairs(terms, index, width).where("at1 <> at2")
    first = index.join(windows, index["term"] == windows["term1"]).select(
        "item", "doc", "at2", "term2", (F.col("pos") - F.col("at1") + F.col("start")).alias("start"),
        (F.col("pos") - F.col("at1") + F.col("at2")).alias("due"),
        F.explode(F.array(*[F.lit(i) for i in range(-slop, slop + 1) if i])).alias("off"))
    second = index.select("doc", F.col("term").alias("term2"), F.col("pos").alias("at_pos"))
    return (first.withColumn("at_pos", F.col("due") + F.col("off")).join(second, ["doc", "term2", "at_pos"], "left_semi")
            .select("doc", "item", "start").distinct())


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: id, n_words, hit (number of words inside a window's occurrence) and the
    found items' ids as strings, sorted."""
    terms, vocabulary = item_terms(items, item_id_col, item_text_col)
    index, ends = build_index(docs, vocabulary, id_col, text_col)
    hits = materialize(occurrences(index, terms, width), "decontam-hits")
    per_doc = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # Words of the union of intervals: each adds what lies beyond all before it.
    spans = hits.groupBy("doc", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    covered = (spans.withColumn("reached", F.coalesce(F.max("end").over(per_doc), F.lit(0)))
               .groupBy("doc").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0)))
                                   .cast("long").alias("hit")))
    ids = terms.select("item", F.col("item_id").cast("string").alias("item_id")).distinct()
    named = (hits.select("doc", "item").distinct().join(ids, "item")
             .groupBy("doc").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    return (ends.join(covered, "doc", "left").join(named, "doc", "left")
            .select(F.col("id").alias(id_col), "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
