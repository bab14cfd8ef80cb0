"""Benchmark decontamination by a distributed positional inverted index.

Benchmark items are cut into windows of consecutive words. Over the corpus, the occurrences of the
windows' words are counted, and each window is looked up by its two rarest words: their postings
(word, document, position) are stored, and the two lists are intersected after each position is
shifted by the word's place in the window. What is left are few candidate starts; the document's own
words there decide.

A near match may lack a fifth of a window's words, the two rarest among them. Near matches are therefore looked up by so
many of the rarest words that one must be left, each on its own: every start around a posting of such a word is a
candidate. Words that the corpus lacks are missing from every match and count as such beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hintwise.llm.common import ABSENT, keyed, let, lower_ascii
from hintwise.operators.scaling import small_enough, written

WINDOW_WORDS = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# share of a window's words that have to lie near a candidate for a proximity match
NEAR_SHARE = 0.8
CANDIDATES = "array<struct<start:int,length:int,phrase:string,items:array<string>>>"


def plain_words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased; none of a null text."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.array_remove(F.split(lower_ascii(t), NOT_WORD), ""))


def windows(items: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """(phrase, length, items): the distinct windows of (item_id, text), with the ids (as text) of
    the items that have them. An item of fewer words, but not none, is one window. Null texts have
    none; a null id counts as an empty one."""
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), plain_words(F.col("text")).alias("w"))
    each = cut.where(F.size("w") > 0).select("item", "w", F.explode(F.sequence(
        F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))).alias("i"))
    slices = each.select("item", F.slice("w", F.col("i"), F.lit(length)).alias("s"))
    return slices.groupBy(F.array_join("s", " ").alias("phrase")).agg(
        F.max(F.size("s")).alias("length"), F.sort_array(F.collect_set("item")).alias("items"))


def _only(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose term is among ``terms``, which are broadcast if measured to be small."""
    return rows.join(F.broadcast(terms) if small_enough(terms) else terms, "term", "left_semi")


def tokens(docs: DataFrame) -> DataFrame:
    """(_k1, _k2, words) of documents."""
    return keyed(docs.select("doc_id", "text")).select("_k1", "_k2", plain_words(F.col("text")).alias("words"))


def anchors(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Windows with their two rarest words in ``docs``: (phrase, length, items, t1, o1, t2, o2), a
    word's place being its offset in the window. A window of one word has no second."""
    places = found.select("phrase", F.posexplode(F.split("phrase", " ")).alias("o", "term"))
    terms = written(places.select("term").distinct(), "test-terms")
    counts = _only(tokens(docs).select(F.explode("words").alias("term")), terms).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"))
    ranked = places.join(counts, "term", "left").groupBy("phrase").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", "term"))).alias("r"),
        F.min(F.coalesce("n", F.lit(0))).alias("least"),
    )
    # a window with a word that the corpus lacks occurs nowhere
    return found.join(ranked.where("least > 0"), "phrase").select(
        "phrase", "length", "items", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["o"].alias("o1"),
        F.get("r", F.lit(1))["term"].alias("t2"), F.get("r", F.lit(1))["o"].alias("o2"),
    )


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of some terms: (term, _k1, _k2, pos)."""
    rows = tokens(docs).select("_k1", "_k2", F.posexplode("words").alias("pos", "term"))
    return _only(rows, terms).select("term", "_k1", "_k2", "pos")


def candidates(index: DataFrame, looked_up: DataFrame) -> DataFrame:
    """(_k1, _k2, start, length, phrase, items): where the two rarest words of a window lie as far
    apart as in the window."""
    first = F.broadcast(looked_up) if small_enough(looked_up) else looked_up
    starts = index.join(first, F.col("term") == F.col("t1")).select(
        "_k1", "_k2", (F.col("pos") - F.col("o1")).alias("start"), "length", "phrase", "items",
        "t2", (F.col("pos") - F.col("o1") + F.col("o2")).alias("p2"),
    ).where("start >= 0")
    second = index.select(F.col("term").alias("t2"), "_k1", "_k2", F.col("pos").alias("p2"))
    met = starts.where("t2 IS NOT NULL").join(second, ["_k1", "_k2", "t2", "p2"], "left_semi")
    columns = ["_k1", "_k2", "start", "length", "phrase", "items"]
    return starts.where("t2 IS NULL").select(*columns).unionByName(met.select(*columns)).distinct()


def _found(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """(_k1, _k2, c): the candidates of the documents that have any."""
    looked_up = written(anchors(written(windows(items, length), "test-windows"), docs), "test-anchors")
    terms = written(looked_up.select(F.explode(F.array("t1", "t2")).alias("term")).where(
        "term IS NOT NULL").distinct(), "anchor-terms")
    index = written(postings(docs, terms), "postings")
    return written(candidates(index, looked_up).groupBy("_k1", "_k2").agg(F.collect_list(F.struct(
        "start", "length", "phrase", "items")).cast(CANDIDATES).alias("c")), "candidates")


def _with_candidates(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """doc_id, words and the candidates (c) of every row; rows without any have null. Candidates grow
    with the corpus, so they meet their texts by a shuffle at every size."""
    found = _found(docs, items, length)
    rows = keyed(docs.select("doc_id", "text"))
    return rows.join(found.hint("merge"), ["_k1", "_k2"], "left").select(
        F.nullif("_k1", F.lit(ABSENT)).alias("doc_id"), plain_words(F.col("text")).alias("words"), "c")


def _at(words: Column, c: Column) -> Column:
    return F.array_join(F.slice(words, c["start"] + 1, c["length"]), " ")


def matches(docs: DataFrame, items: DataFrame, length: int = WINDOW_WORDS, slack: int = 0) -> DataFrame:
    """(doc_id, kind, start, length, phrase, items), one row per occurrence of a benchmark window, its kind being
    ``exact``; with ``slack``, what :func:`near_matches` finds. Positions count words.

    Rows that repeat an id and a text repeat their matches. Null and empty texts have none, as has an empty
    corpus or benchmark; very long texts are read whole; other columns are ignored."""
    if slack:
        return near_matches(docs, items, length, slack)
    rows = _with_candidates(docs, items, length).where("c IS NOT NULL")
    return rows.select("doc_id", "words", F.explode("c").alias("x")).where(
        _at(F.col("words"), F.col("x")) == F.col("x.phrase")).select("doc_id", F.lit("exact").alias("kind"), "x.*")


def near_anchors(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Windows with the rarest words of which a near match has at least one: (phrase, length, items, own, term,
    offsets), a row per word. ``own`` are the window's distinct words, ``offsets`` the word's places in it."""
    places = found.select("phrase", F.posexplode(F.split("phrase", " ")).alias("o", "term")).groupBy("phrase", "term").agg(
        F.sort_array(F.collect_list("o")).alias("offsets"))
    terms = written(places.select("term").distinct(), "test-terms")
    counts = _only(tokens(docs).select(F.explode("words").alias("term")), terms).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = places.join(counts, "term", "left").groupBy("phrase").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offsets"))).alias("r"))
    absent = F.size(F.filter("r", lambda x: x["n"] == 0))
    may_lack = F.size("r") - F.ceil(F.size("r") * F.lit(NEAR_SHARE)).cast("int")
    kept = found.join(ranked, "phrase").where(absent <= may_lack)
    return kept.select("phrase", "length", "items", F.transform("r", lambda x: x["term"]).alias("own"), F.explode(
        F.slice("r", absent + 1, may_lack - absent + 1)).alias("x")).select("phrase", "length", "items", "own", "x.term", "x.offsets")


def near_matches(docs: DataFrame, items: DataFrame, length: int = WINDOW_WORDS, slack: int = 2) -> DataFrame:
    """(doc_id, kind, start, length, phrase, items): exact and near matches of benchmark windows.

    A window is near a start if at least 80 % of its distinct words lie within its span there, widened by ``slack``
    words on both sides. Each run of consecutive such starts is one match, at the start with the most of the words
    inside the span, an exact one first, then the least; its kind is ``exact`` or ``near``. A start may be up to ``slack`` words before
    the text's first. Rows that repeat an id and a text give their matches once. Null and empty texts have none, as
    has an empty corpus or benchmark; very long texts are read whole; other columns are ignored.
    """
    looked_up = written(near_anchors(written(windows(items, length), "test-windows"), docs), "test-anchors")
    terms = written(looked_up.select("term").distinct(), "anchor-terms")
    index = written(postings(docs, terms), "postings")
    # a posting may stand anywhere in the widened span
    around = F.sequence(F.col("pos") - F.col("length") - slack + 1, F.col("pos") + slack)
    met = index.join(F.broadcast(looked_up) if small_enough(looked_up) else looked_up, "term")
    starts = met.select("_k1", "_k2", "phrase", "length", "items", "own", F.explode(around).alias("start")).where(
        F.col("start") >= -slack).distinct()
    asked = written(starts.groupBy("_k1", "_k2").agg(F.collect_list(F.struct(
        "start", "length", "phrase", "items", "own")).alias("c")), "near-candidates")
    rows = keyed(docs.select("doc_id", "text")).select("_k1", "_k2", "text").join(asked.select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").groupBy(
        "_k1", "_k2").agg(F.min("text").alias("text"))

    def measured(w: Column, c: Column) -> Column:
        span = lambda wider: F.array_distinct(F.slice(
            w, F.greatest(c["start"] - wider, F.lit(0)) + 1,
            F.greatest(c["start"] + c["length"] + wider - F.greatest(c["start"] - wider, F.lit(0)), F.lit(0))))
        inside = F.size(F.array_intersect(c["own"], span(0)))
        enough = F.size(F.array_intersect(c["own"], span(slack))) >= NEAR_SHARE * F.size(c["own"])
        exact = (c["start"] >= 0) & (_at(w, c) == c["phrase"])
        return F.when(enough, F.struct(c["start"].alias("start"), c["length"].alias("length"), c["phrase"].alias("phrase"),
                                       c["items"].alias("items"), inside.alias("inside"), exact.alias("exact")))

    near = rows.join(asked.hint("merge"), ["_k1", "_k2"]).select("_k1", "_k2", F.explode(let(
        plain_words(F.col("text")), lambda w: F.filter(F.transform("c", lambda c: measured(w, c)), lambda x: x.isNotNull()))).alias("x")).select(
        "_k1", "_k2", "x.*")
    # consecutive starts differ from their numbers by the same amount
    run = F.col("start") - F.row_number().over(W.partitionBy("_k1", "_k2", "phrase").orderBy("start"))
    best = F.max_by(F.struct("start", "length", "items", "exact"), F.struct("exact", "inside", (-F.col("start")).alias("first")))
    return near.withColumn("_run", run).groupBy("_k1", "_k2", "phrase", "_run").agg(best.alias("b")).select(
        F.nullif("_k1", F.lit(ABSENT)).alias("doc_id"), F.when(F.col("b.exact"), "exact").otherwise("near").alias("kind"),
        "b.start", "b.length", "phrase", "b.items")


def contamination(docs: DataFrame, items: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, items), one row per row of ``docs``: how many words lie inside an
    occurrence of a benchmark window, and the items (ids as sorted text) with such windows.

    Null texts have no words and no hits. Rows that repeat an id and a text share their result. An
    empty corpus gives no rows, an empty benchmark no hits. Other columns are ignored.
    """
    rows = _with_candidates(docs, items, length)

    def counted(w: Column, c: Column) -> Column:
        hit = F.array_distinct(F.flatten(F.transform(c, lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
        names = F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda x: x["items"]))))
        return F.struct(F.size(w).alias("n_words"), F.size(hit).alias("n_hit"), names.alias("items"))

    none = F.array().cast(CANDIDATES)
    found = F.when(F.col("c").isNull(), F.struct(
        F.size("words").alias("n_words"), F.lit(0).alias("n_hit"), F.array().cast("array<string>").alias("items")
    )).otherwise(let(F.col("words"), lambda w: let(
        F.filter(F.coalesce("c", none), lambda x: _at(w, x) == x["phrase"]), lambda c: counted(w, c)
    )))
    return rows.select("doc_id", found.alias("_r")).select(
        "doc_id", F.col("_r.n_words").cast("bigint").alias("n_words"), F.col("_r.n_hit").cast("bigint").alias("n_hit"), "_r.items")


def clean(docs: DataFrame, items: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs``, with their columns, in which no benchmark window occurs. Null and empty texts stay, as
    does everything beside an empty benchmark; repeated rows stay or go together; columns of any names travel along."""
    found = _found(docs, items, length)
    rows = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text"))
    joined = rows.join(found.hint("merge"), ["_k1", "_k2"], "left")
    hit = F.when(F.col("c").isNull(), False).otherwise(let(plain_words(F.col("text")), lambda w: F.exists(
        "c", lambda x: _at(w, x) == x["phrase"])))
    return joined.where(~hit).select("_row.*")
