"""Quality rules: counts of words, symbols, repeated lines and windows, and divergence from a language's usual histograms.

Everything is a DataFrame expression. A document's characters fall into eight classes, its words into the common words of its
language, one bin each, and all the rest, one bin more. Each language's reference is the mean histogram of its own documents that pass the counts and are
long enough to be judged; a document is rejected when the Jensen-Shannon distance of either histogram to its reference is too
large. Texts are read once; the histograms, a few numbers a document, are stored in between.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.runtime import settle

BLANKS = r"\x20\x09-\x0D"
SYMBOLS = r"#*$%&|<>"

#: Common words that a histogram counts, by the language column; other languages are judged on characters only.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "be", "with", "as", "by", "at", "from"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "sur", "pas", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su"],
}

#: Character classes, taken out of the text one after another, each from what the ones before have left.
CLASSES = {
    "small": "a-z",
    "white": BLANKS,
    "capital": "A-Z",
    "letter": r"\p{L}\p{M}",
    "digit": r"\p{Nd}",
    "symbol": SYMBOLS,
    "mark": r"\x21-\x7E",
}


def _sum(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def text_counts(text: Column) -> dict[str, Column]:
    """Expressions over a text column (null: empty) that need no more than the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    return {"n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")}


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more in the array, the first occurrence included.

    Windows are known by 64-bit hashes, sorted with their places; the covered words are the sum of the steps, of at most
    three, from each repeated window to the next.
    """
    last = F.size(words) - 3
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    sorted_ = F.sort_array(windows)
    return F.when(last >= 1, sorted_)


def covered(ordered: Column) -> Column:
    """The number of words under repeated windows, from the sorted windows of ``repeated_words``."""
    same = F.transform(
        ordered,
        lambda x, k: F.when(
            (F.get(ordered, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(ordered, k + 1)["h"].eqNullSafe(x["h"])), x["i"]
        ),
    )
    places = F.sort_array(F.filter(same, lambda x: x.isNotNull()))
    total = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"), x.alias("at")),
        lambda a: a["n"],
    )
    return F.coalesce(total, F.lit(0)).cast("long")


def measure(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and histograms of every document, one row for each row of the input."""
    base = documents.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    words = F.filter(F.split("text", f"[{BLANKS}]+"), lambda x: x != "")
    df = base.select("id", "lang", "text_hash", "text", words.alias("words"), *(c.alias(k) for k, c in text_counts(F.col("text")).items()))
    left = df.withColumn("left", F.col("text")).drop("text").withColumn("n_chars", F.length("left").cast("long"))
    for name, chars in CLASSES.items():
        left = left.withColumn("less", F.regexp_replace("left", f"[{chars}]+", ""))
        left = left.withColumn(f"c_{name}", (F.length("left") - F.length("less")).cast("long")).drop("left")
        left = left.withColumnRenamed("less", "left")
    left = left.withColumn("c_other", F.length("left").cast("long")).drop("left")
    listed = F.create_map(*(x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    every = sorted({w for v in COMMON_WORDS.values() for w in v})
    ordered = left.withColumn("ordered", repeated_words(F.col("words"))).withColumn("common", F.try_element_at(listed, F.col("lang")))
    found = ordered.withColumn(
        "found", F.when(F.col("common").isNotNull(), F.filter(F.transform("words", F.lower), lambda x: x.isin(every)))
    )
    counts = F.transform("common", lambda c: F.size(F.filter("found", lambda x: x == c)).cast("double"))
    return found.select(
        "id",
        "lang",
        "text_hash",
        F.size("words").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("c_white")).alias("word_chars"),
        F.col("c_symbol").alias("n_symbols"),
        "n_dup_lines",
        covered(F.col("ordered")).alias("n_repeat_words"),
        F.array(*(F.col(f"c_{k}").cast("double") for k in [*CLASSES, "other"])).alias("chars"),
        counts.alias("commons"),
        F.size("found").alias("n_listed"),  # a second use of the array, so that it is not recomputed inside the histogram
    )


def _shares(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(values, lambda x: x / total))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2: 0 for equal distributions, 1 for those that share nothing. Null if either is."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    total = F.aggregate(
        F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2), F.lit(0.0), lambda s, x: s + x
    )
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def judge(
    documents: DataFrame,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    judged_words: int = 50,
    max_char_distance: float = 0.3,
    max_word_distance: float = 0.28,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Counts and the verdict for every document.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance, text_hash``, the last
    Spark's xxhash64 of the text, to find the row again where ids repeat.
    A null text is an empty one, a null language a language of its own; one row for each row of the input, repeated
    ids included; an empty table gives no rows; other columns are not read. Distances are null, and do not
    count, below ``judged_words`` words or where a language has no reference; the word distance also where no common words are
    listed for the language. A text without any of the common words is judged like every other. ``max_word_distance`` lies in the
    valley between the two heaps of word distances: around 0.1, and around 0.33 for texts with almost no common words.
    """
    found = settle(measure(documents, id_col, text_col, lang_col), "quality")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rest = F.col("n_words") - F.aggregate("commons", F.lit(0.0), lambda a, x: a + x)
    rows = found.withColumn("base_failed", failed).withColumn("word_bins", F.concat("commons", F.array(rest)))
    rows = rows.withColumn("p_chars", F.when(F.col("n_words") >= judged_words, _shares(F.col("chars"))))
    rows = rows.withColumn("p_words", F.when(F.col("n_words") >= judged_words, _shares(F.col("word_bins"))))
    bins = len(CLASSES) + 1
    most = max(map(len, COMMON_WORDS.values())) + 1
    means = (
        rows.filter(~F.col("base_failed"))
        .groupBy("lang")
        .agg(
            *(F.avg(F.get("p_chars", F.lit(k))).alias(f"c{k}") for k in range(bins)),
            *(F.avg(F.get("p_words", F.lit(k))).alias(f"w{k}") for k in range(most)),
        )
    )
    reference = means.select(
        "lang",
        F.when(F.col("c0").isNotNull(), F.array(*(f"c{k}" for k in range(bins)))).alias("q_chars"),
        F.when(F.col("w0").isNotNull(), F.filter(F.array(*(f"w{k}" for k in range(most))), lambda x: x.isNotNull())).alias("q_words"),
    )
    joined = rows.join(settle(reference, "references"), "lang", "left")
    told = joined.withColumn("char_distance", js_distance(F.col("p_chars"), F.col("q_chars")))
    told = told.withColumn("word_distance", js_distance(F.col("p_words"), F.col("q_words")))
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > max_word_distance
    )
    return told.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"),
        "char_distance",
        "word_distance",
        "text_hash",
    )
