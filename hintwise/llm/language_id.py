"""Language identification by interpolated Kneser-Ney models of characters.

A model counts runs of four characters per language on labelled texts and smooths them by
interpolated Kneser-Ney. It is stored as sorted arrays of 64-bit n-gram keys (four 16-bit
characters), each with the log-probabilities of those languages that have it, so the model grows with
what the languages hold and not with their number times all of it. A text gets the language of least
cross-entropy per character, and is rejected where that lies beyond what labelled texts show.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hintwise.llm.common import hand_back, per_process, short_batches
from hintwise.operators.scaling import written

ORDER = 4
UNKNOWN = "und"
# labelled texts that a model is fitted on, and that set its rejection limits: languages share
# these numbers evenly, but the share of a language is never less than the third number
FIT_DOCUMENTS = 12_000
CALIBRATION_DOCUMENTS = 4_000
LEAST_DOCUMENTS = 200
# a language that fewer texts calibrate has no limit
LEAST_CALIBRATION = 8
# characters that are scored at once, divided by the number of languages
CHUNK_CHARS = 1 << 21
REJECT_QUANTILE = 0.999
# added to the quantile, in nats per character; the second is divided by the root of the length
SLACK, SHORT_SLACK = 0.5, 4.0
# largest model that is sent to the executors
MOST_MODEL_BYTES = 256 << 20
# characters after which a score is as sure as it gets
SURE_AFTER = 60


def _letters() -> np.ndarray:
    """By 16-bit character: whether it is a letter. Characters beyond count by their lower half."""
    return per_process("letters", lambda: np.array([chr(i).isalpha() for i in range(1 << 16)]))


def character_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters of all texts, each run of other than letters being one blank, with
    three blanks before and one after each text; and where the texts start (one more at the end)."""
    joined = "\x00".join(texts).lower() + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(codes == 0)
    if len(ends) != len(texts):  # a text with a null character of its own
        return character_runs([t.replace("\x00", " ") for t in texts])
    low = (codes & 0xFFFF).astype(np.uint16)
    codes = np.where(_letters()[low], low, np.uint16(32))
    keep = (codes != 32) | np.concatenate(([True], codes[:-1] != 32))
    keep[ends] = True
    # the blank before an end is the end's own
    before = ends[(ends > 0)] - 1
    keep[before[codes[before] == 32]] = False
    starts = np.concatenate(([0], ends[:-1] + 1))
    blank_first = starts[(codes[starts] == 32) & (starts < ends)]
    keep[blank_first] = False
    times = keep.astype(np.int8)
    sizes = np.add.reduceat(keep, starts, dtype=np.int64)
    out = np.full(int(sizes.sum()) + 3 * len(texts), 32, np.uint16)
    first = np.concatenate(([0], np.cumsum(sizes + 3)))
    place = np.arange(int(times.sum())) + 3 * (np.repeat(np.arange(len(texts)), sizes) + 1)
    out[place] = codes[keep]
    return out, first


def ngram_keys(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the four-character runs that end at each character of each text, and where the
    texts' keys start. The three blanks before a text end no run."""
    c = codes.astype(np.uint64)
    keys = np.zeros(len(c), np.uint64)
    for back in range(ORDER):
        keys[back:] |= c[: len(c) - back] << np.uint64(16 * back)
    ends = np.ones(len(c), bool)
    for k in range(ORDER - 1):
        ends[first[:-1] + k] = False
    return keys[ends], first - (ORDER - 1) * np.arange(len(first))


@dataclass
class Table:
    """Sorted distinct keys; those of number i have the entries ``ends[i - 1]`` to ``ends[i]`` (language, value)."""

    keys: np.ndarray
    ends: np.ndarray
    language: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Table:
        """From (sorted keys, values) of each language in turn."""
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        known, n = np.unique(keys, return_counts=True)
        language = np.repeat(np.arange(len(parts), dtype=np.int16), [len(k) for k, _ in parts])[order]
        return cls(known, np.cumsum(n).astype(np.int64), language, np.concatenate([v for _, v in parts])[order].astype(np.float32))

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, language, value) of the keys that are known, row being a key's place."""
        if not len(self.keys):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        rows = np.flatnonzero(self.keys[at] == keys)
        last = self.ends[at[rows]]
        first = np.where(at[rows] > 0, self.ends[at[rows] - 1], 0)
        n = last - first
        place = np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())
        return np.repeat(rows, n), self.language[place], self.value[place]

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.ends, self.language, self.value))


@dataclass
class Model:
    """Per order (1 to 4) the log-probabilities of runs; per order (1 to 3) the log-weights with which a
    context hands on to the shorter one."""

    languages: list[str]
    grams: dict[int, Table]
    contexts: dict[int, Table]
    floor: np.ndarray
    limits: dict[str, float] | None = None

    @property
    def nbytes(self) -> int:
        return sum(t.nbytes for t in (*self.grams.values(), *self.contexts.values()))

    def log_probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """[keys, languages], as float32; unseen runs fall back to shorter ones."""
        if order == 1:
            out = np.repeat(self.floor[None, :], len(keys), axis=0)
        else:
            shorter, at = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_inverse=True)
            out = self.log_probabilities(shorter, order - 1)[at]
            row, language, weight = self.contexts[order - 1].entries(keys >> np.uint64(16))
            out[row, language] += weight
        row, language, value = self.grams[order].entries(keys)
        out[row, language] = value
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[texts, languages] in nats per character, and the texts' characters."""
        keys, first = ngram_keys(*character_runs(texts))
        distinct, at = np.unique(keys, return_inverse=True)
        sums = np.add.reduceat(self.log_probabilities(distinct)[at], first[:-1], axis=0, dtype=np.float64)
        n = np.diff(first)
        return -sums / n[:, None], n


def _kneser_ney(keys: np.ndarray, counts: np.ndarray, alphabet: int):
    """One language: {order: (keys, probabilities)}, {order: (contexts, weights)}, floor."""
    levels = {ORDER: (keys, counts.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before a run
        shorter, n = np.unique(levels[order + 1][0] & np.uint64((1 << 16 * order) - 1), return_counts=True)
        levels[order] = (shorter, n.astype(np.float64))
    grams, contexts, floor = {}, {}, 1.0 / alphabet
    for order in range(1, ORDER + 1):
        k, n = levels[order]
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context, at = np.unique(k >> np.uint64(16), return_inverse=True)
        total = np.bincount(at, n, len(context))
        weight = discount * np.bincount(at, minlength=len(context)) / total
        if order == 1:
            below = np.full(len(k), 1.0 / alphabet)
            floor = weight[0] / alphabet if len(weight) else 1.0 / alphabet
        else:
            shorter, p = grams[order - 1]
            below = p[np.searchsorted(shorter, k & np.uint64((1 << 16 * (order - 1)) - 1))]
            contexts[order - 1] = (context, weight)
        grams[order] = (k, (n - discount) / total[at] + weight[at] * below)
    return grams, contexts, floor


def build(counts: pd.DataFrame) -> Model:
    """A model from (lang, key, n): how often each run occurs in each language."""
    languages = sorted(counts["lang"].unique())
    if not languages:
        return Model([], {}, {}, np.zeros(0, np.float32))
    all_keys = counts["key"].to_numpy(np.int64).view(np.uint64)
    alphabet = len(np.unique(all_keys & np.uint64(0xFFFF)))
    own = []
    for lang in languages:
        rows = counts[counts["lang"] == lang]
        keys = rows["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        own.append(_kneser_ney(keys[order], rows["n"].to_numpy(np.float64)[order], alphabet))
    floor = np.log([f for _, _, f in own]).astype(np.float32)
    grams = {order: Table.of([(g[order][0], np.log(g[order][1])) for g, _, _ in own]) for order in range(1, ORDER + 1)}
    contexts = {order: Table.of([(c[order][0], np.log(c[order][1])) for _, c, _ in own]) for order in range(1, ORDER)}
    return Model(languages, grams, contexts, floor)


def _chunks(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield first, i
            first, size = i, 0
        size += len(t) + ORDER
    if first < len(texts):
        yield first, len(texts)


def count_runs(docs: DataFrame) -> DataFrame:
    """(lang, key, n) of labelled texts."""
    short_batches(docs.sparkSession)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                texts = rows["text"].tolist()
                for a, b in _chunks(texts, CHUNK_CHARS // 4):
                    keys, n = np.unique(ngram_keys(*character_runs(texts[a:b]))[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": n})
        hand_back()

    found = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(
        runs, "lang string, key bigint, n bigint")
    return found.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _level(sizes: list[int], total: int) -> int:
    """The bound per language at which languages of these sizes have ``total`` texts or less between
    them, or ``LEAST_DOCUMENTS`` if that is more."""
    left, level = total, max(sizes, default=0)
    for i, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if n > share:
            level = share
            break
        left -= n
    return max(level, LEAST_DOCUMENTS)


def samples(usable: DataFrame, fit_documents: int, calibration_documents: int) -> tuple[DataFrame, DataFrame]:
    """Texts to fit on and texts to calibrate with, both (doc_id, text, lang, fold) and sampled by
    language. The fold, 0 or 1, is a hash of the text, so copies of a text are in the same one."""
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = 1 << 30
    to_fit, to_calibrate = (_level(list(sizes.values()), n) for n in (fit_documents, calibration_documents))
    rates = usable.sparkSession.createDataFrame(
        [(lang, min(whole, whole * to_fit // n), min(whole, whole * to_calibrate // n)) for lang, n in sizes.items()],
        "lang string, _fit long, _calibrate long")
    place = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id", "text"), F.lit(whole))
    rows = usable.select("doc_id", "text", "lang", F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(2)).alias("fold")).join(
        F.broadcast(rates), "lang").withColumns({"_a": place(1) < F.col("_fit"), "_b": place(2) < F.col("_calibrate")})
    # both samples come out of one pass; what follows reads no other text
    taken = written(rows.where("_a OR _b").select("doc_id", "text", "lang", "fold", "_a", "_b"), "language-samples")
    return taken.where("_a").drop("_a", "_b"), taken.where("_b").drop("_a", "_b")


def fit(
    labelled: DataFrame, fit_documents: int = FIT_DOCUMENTS, calibration_documents: int = CALIBRATION_DOCUMENTS,
) -> Model:
    """Fit a model on (doc_id, text, lang) and set its rejection limits.

    At most about ``fit_documents`` whole texts are counted (``LEAST_DOCUMENTS`` per language, if that
    is more), so the counts that come to the driver are bounded: common languages are sampled down to
    the same number of texts, rarer ones are taken whole. About ``calibration_documents`` texts, sampled
    in the same way, set per language the cross-entropy that 0.1 % of its texts exceed. They are in two
    folds, and each is scored by a model that has learned from the other only, so no text is scored by
    what it taught. A language has no limit if fewer than ``LEAST_CALIBRATION`` of its texts are told
    right there. Rows without text, letter or language teach nothing.
    """
    usable = labelled.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    fit_on, calibrate_with = samples(usable, fit_documents, calibration_documents)
    counts = count_runs(fit_on.withColumn("lang", F.concat(F.col("fold").cast("string"), "lang"))).toPandas()
    counts["fold"], counts["lang"] = counts["lang"].str[0], counts["lang"].str[1:]
    model = build(counts.groupby(["lang", "key"], as_index=False)["n"].sum())
    if not model.languages:
        return model
    scored = [predict(calibrate_with.where(F.col("fold") == fold), build(counts[counts["fold"] == str(1 - fold)]), ("lang",))
              for fold in (0, 1)]
    right = scored[0].unionByName(scored[1]).where("lang = lang_pred").groupBy("lang").agg(
        F.percentile_approx("cross_entropy", REJECT_QUANTILE, 10_000).alias("limit"), F.count(F.lit(1)).alias("n"))
    model.limits = {r.lang: r.limit for r in right.where(F.col("n") >= LEAST_CALIBRATION).collect()}
    return model


def _scorer(spark: SparkSession, model: Model):
    if model.nbytes > MOST_MODEL_BYTES:
        raise ValueError(f"the model of {len(model.languages)} languages has {model.nbytes} bytes; fit it on fewer texts")
    short_batches(spark)
    shared = spark.sparkContext.broadcast(dict(vars(model)))  # plain arrays

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        letter = regex.compile(r"\p{L}").search
        m = Model(**shared.value)
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        limits = np.array([(m.limits or {}).get(x, np.inf) for x in m.languages])
        for batch in batches:
            texts = batch.tolist()
            usable = [i for i, t in enumerate(texts) if m.languages and t and letter(t)]
            best, sure, entropy = np.full(len(texts), -1), np.zeros(len(texts)), np.full(len(texts), np.nan)
            rejected = np.ones(len(texts), bool)
            own = [texts[i] for i in usable]
            for a, b in _chunks(own, max(CHUNK_CHARS // max(4, 2 * len(m.languages)), 1)):
                h, n = m.cross_entropies(own[a:b])
                at, rows = np.argmin(h, axis=1), np.array(usable[a:b])
                least = h[np.arange(len(h)), at]
                odds = np.exp((least[:, None] - h) * np.minimum(n, SURE_AFTER)[:, None]).sum(axis=1)
                best[rows], sure[rows], entropy[rows] = at, 1 / odds, least
                rejected[rows] = least > limits[at] + SLACK + SHORT_SLACK / np.sqrt(n)
            yield pd.DataFrame({"lang_pred": names[best], "score": sure, "cross_entropy": entropy, "rejected": rejected})
        del m
        hand_back()

    return score


def predict(docs: DataFrame, model: Model, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *more, lang_pred, score, cross_entropy, rejected), one row per input row.

    ``und`` with score 0 and rejected stand where a text is null or has no letter, and everywhere
    if the model learned no language. The score is the best language's share of the likelihoods,
    at no more than ``SURE_AFTER`` characters. Ties go to the first language by name. Long texts are
    scored whole. Repeated rows give repeated results; an empty table gives none.
    """
    score = _scorer(docs.sparkSession, model)
    return docs.select("doc_id", *more, score("text").alias("_r")).select(
        "doc_id", *more, "_r.lang_pred", "_r.score",
        F.nanvl("_r.cross_entropy", F.lit(None).cast("double")).alias("cross_entropy"), "_r.rejected")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is identified and not rejected. Null and empty texts and
    those without a letter go; repeated rows stay or go together; very long texts are scored whole; an empty table
    gives none; columns of any names travel along."""
    score = _scorer(docs.sparkSession, model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), score("text").alias("_r"))
    return rows.where("NOT _r.rejected").select("_row.*")


def held_out(modulus: int = 4, remainder: int = 2):
    """Whether crc32 of the id, as text, leaves the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder
