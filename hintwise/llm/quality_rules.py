"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintwise.llm.common import BLANK_RUN, let, words

SYMBOLS = "#*$%&|<>"
# fixed values: function words by language. The first four are also a feature of the quality classifier
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "was", "with", "as", "be", "by"),
    "de": ("der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "ein", "eine", "nicht", "auf"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "pour", "dans", "en", "du"),
    "es": ("el", "los", "las", "y", "del", "con", "por", "se", "no", "al", "una"),
    "it": ("il", "lo", "gli", "di", "che", "non", "per", "sono", "della", "nel", "ha"),
    "pt": ("o", "os", "as", "um", "uma", "do", "da", "em", "não", "para", "com"),
    "nl": ("het", "een", "van", "niet", "dat", "op", "zijn", "voor", "aan", "ook"),
    "sv": ("och", "att", "det", "som", "är", "på", "av", "för", "inte", "till"),
    "da": ("og", "at", "er", "på", "af", "ikke", "til", "med", "som", "den"),
    "fi": ("ja", "on", "ei", "se", "että", "oli", "mutta", "kun", "myös", "hän"),
    "pl": ("i", "w", "na", "z", "nie", "jest", "się", "że", "jak", "ale"),
    "cs": ("a", "je", "na", "že", "s", "ve", "který", "jako", "bylo", "ale"),
    "hu": ("a", "az", "és", "hogy", "nem", "egy", "van", "volt", "mint", "csak"),
    "ro": ("și", "în", "este", "cu", "pe", "care", "sunt", "nu", "mai", "din"),
    "tr": ("ve", "bir", "bu", "için", "ile", "da", "çok", "olarak", "gibi", "daha"),
    "id": ("yang", "dan", "di", "untuk", "dengan", "ini", "tidak", "dari", "pada", "adalah"),
    "vi": ("và", "của", "là", "các", "có", "được", "cho", "trong", "một", "không"),
    "ru": ("и", "в", "не", "на", "что", "с", "по", "это", "как", "он"),
    "uk": ("і", "в", "не", "на", "що", "з", "та", "це", "як", "до"),
    "bg": ("и", "на", "да", "от", "за", "се", "е", "не", "с", "по"),
    "el": ("και", "το", "να", "της", "του", "η", "με", "που", "για", "δεν"),
}
CLASSIFIER_LANGUAGES = ("en", "de", "fr", "es")
# scripts that the lists know; of a text in another one they say nothing
SCRIPTS = ("Latin", "Cyrillic", "Greek")


def _all_words(stop_words: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({w for words in stop_words.values() for w in words})


@dataclass(frozen=True)
class Rule:
    """A document fails when ``metric`` is below ``least`` or above ``most``; a metric that is
    null (a ratio of an empty text) fails nothing."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


# the basic rules come first; a document has to pass both lists
BASE_RULES = (
    Rule("too_short", "n_words", least=50),
    Rule("repeats_words", "repeat_percent", most=50),
)
RULES = (
    Rule("word_length", "mean_word_chars", least=2, most=20),
    Rule("symbols", "symbol_ratio", most=0.15),
    Rule("exclamations", "exclamation_ratio", most=0.15),
    Rule("stop_words", "stop_word_ratio", least=0.01),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("ends_in_ellipsis", "ellipsis_line_ratio", most=0.5),
)



def _ratio(over: str, under: str) -> Column:
    return F.when(F.col(under) > 0, F.col(over) / F.col(under))


def metrics() -> dict[str, Column]:
    """What rules can name, over the columns of ``text_statistics``."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_percent": 100 * _ratio("n_repeat_words", "n_words"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "exclamation_ratio": _ratio("n_exclamations", "n_words"),
        # null where most characters are letters of scripts that the word lists lack
        "stop_word_ratio": F.when(2 * F.col("n_foreign_letters") <= F.col("word_chars"), _ratio("n_stop_words", "n_words")),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": _ratio("n_ellipsis_lines", "n_lines"),
    }


def _repeated_positions(w: Column) -> Column:
    """Starts of the 3-word windows that occur twice or more, ascending.

    Windows are sorted by 32 bits of a hash, with the position in the lower half of the same
    number. Neighbours with equal hashes are candidates. Only if two such neighbours have
    different words are the candidates sorted again by their words.
    """
    def hash_bits(x: Column) -> Column:
        return F.shiftright(x, 32)

    def start(x: Column) -> Column:
        return x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")

    def same(a: Column, b: Column) -> Column:
        return (w[a] == w[b]) & (w[a + 1] == w[b + 1]) & (w[a + 2] == w[b + 2])

    packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
        w[i], w[i + 1], w[i + 2]
    ).bitwiseAND(F.lit(-1 << 32)).bitwiseOR(i.cast("bigint"))))

    def candidates(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(
            (hash_bits(x) == hash_bits(F.get(s, i + 1))) | (hash_bits(x) == hash_bits(F.get(s, i - 1))),
            hash_bits(x) == hash_bits(F.coalesce(F.get(s, i + 1), F.get(s, i - 1))), F.lit(False),
        ))

    def by_words(c: Column) -> Column:
        found = F.sort_array(F.transform(c, lambda x: let(start(x), lambda i: F.struct(
            F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("i")
        ))))
        return let(found, lambda s: F.transform(F.filter(s, lambda x, i: (
            F.coalesce(x["g"] == F.get(s, i + 1)["g"], F.lit(False))
            | F.coalesce(x["g"] == F.get(s, i - 1)["g"], F.lit(False))
        )), lambda x: x["i"]))

    def verified(c: Column) -> Column:
        clash = F.exists(F.sequence(F.lit(1), F.size(c) - 1), lambda k: (
            (hash_bits(c[k]) == hash_bits(c[k - 1])) & ~same(start(c[k]), start(c[k - 1]))
        ))
        return F.when(F.size(c) < 2, F.array().cast("array<int>")).otherwise(
            F.sort_array(F.when(clash, by_words(c)).otherwise(F.transform(c, start)))
        )

    return F.when(F.size(w) < 4, F.array().cast("array<int>")).otherwise(
        let(let(packed, candidates), verified)
    )


def _covered(starts: Column) -> Column:
    """Words that 3-word windows with these ascending starts cover."""
    return let(starts, lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0), lambda s, x: s + x,
    ))


def text_statistics(
    text: Column, stop_words: dict[str, tuple[str, ...]] | None = None, scripts: tuple[str, ...] = SCRIPTS,
) -> Column:
    """Counts of one text as a struct of longs; a null text counts like an empty one. Stop words are those of the
    quality classifier, unless lists by language are given, with the Unicode scripts that they are written in."""
    known = _all_words({k: STOP_WORDS[k] for k in CLASSIFIER_LANGUAGES} if stop_words is None else stop_words)
    foreign = "[\\p{L}&&[^" + "".join(f"\\p{{Is{x}}}" for x in scripts) + "]]"

    def of(w: Column, ln: Column, t: Column) -> Column:
        counts = {
            "n_words": F.size(w),
            "word_chars": F.char_length(F.regexp_replace(t, BLANK_RUN, "")),
            "n_symbols": F.char_length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")),
            "n_exclamations": F.char_length(F.regexp_replace(t, "[^!?]+", "")),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*known))),
            **({} if stop_words is None else {"n_foreign_letters": F.regexp_count(t, F.lit(foreign))}),
            "n_lines": F.size(ln),
            "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
            "n_ellipsis_lines": F.size(F.filter(ln, lambda x: x.endswith("...") | x.endswith("\u2026"))),
            "n_repeat_words": _covered(_repeated_positions(w)),
        }
        return F.struct(*[c.cast("bigint").alias(name) for name, c in counts.items()])

    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: let(
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")), lambda ln: of(w, ln, t)
    )))


def failed_rules(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that a document breaks, in order."""
    named = metrics()

    def broken(rule: Rule) -> Column:
        value, tests = named[rule.metric], []
        if rule.least is not None:
            tests.append(value < F.lit(float(rule.least)))
        if rule.most is not None:
            tests.append(value > F.lit(float(rule.most)))
        return F.when(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(rule.name))

    return F.array_compact(F.array(*map(broken, rules)))


def apply_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES,
    stop_words: dict[str, tuple[str, ...]] = STOP_WORDS, scripts: tuple[str, ...] = SCRIPTS,
) -> DataFrame:
    """doc_id, the counts, base_failed, failed (names of broken rules) and kept, one row per row.

    ``stop_words`` are lists by language, ``scripts`` the Unicode scripts that they are written in. A text most of whose
    characters are letters of other scripts is not judged by its stop words. A language of these scripts has to be listed.

    A null or empty text has no words, so it breaks ``too_short``. Repeated rows give repeated
    results; other columns are ignored, whatever their names. No shuffle, no state.
    """
    counted = docs.select("doc_id", text_statistics(F.col("text"), stop_words, scripts).alias("_s")).select("doc_id", "_s.*")
    flagged = counted.select(
        "*", (F.size(failed_rules(base)) > 0).alias("base_failed"), failed_rules(rules).alias("failed")
    )
    return flagged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
