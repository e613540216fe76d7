"""Words of texts for search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stemmer import stem

# Fixed: the English stop words of the public Snowball list.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now".split()
)
_SPLIT = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits in order; their places count from 1."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def spaced(text: Column) -> Column:
    """The same words as one string, with a space before and after each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _SPLIT, " "), F.lit(" "))


def joined(columns: list[Column]) -> Column:
    """Several texts as one, a space between them; null counts as empty."""
    return F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def places(tokens: Column, forms: list[str], most: int = 255, last: int = 16383) -> Column:
    """Where one of ``forms`` stands among ``tokens``, up to ``most`` places, none beyond ``last``."""
    at = F.filter(F.transform(tokens, lambda w, i: F.when(w.isin(forms), i + 1)), lambda p: p.isNotNull())
    return F.slice(F.transform(at, lambda p: F.least(p, F.lit(last))), 1, most)


#: A place before which no word goes on, and one after which none does.
EDGE_BEFORE, EDGE_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def stemmed(words: Column) -> Column:
    """English stems of a column of words, a batch at a time."""

    @F.pandas_udf("string")
    def run(words):  # noqa: ANN001, ANN202
        return words.map(stem)

    return run(words)


def forms_of(texts: DataFrame, wanted: list[str]) -> dict[str, list[str]]:
    """Of each wanted word the words of ``texts`` (one lower-case column) with its stem, itself among them.

    A word and its stem begin with the same letter, and with the same three where the stem has more than four: only distinct words that begin so are
    stemmed, a batch at a time, and only those that share a wanted stem reach the driver.
    """
    stems = sorted({stem(w) for w in wanted})
    starts = sorted({s[:3] if len(s) > 4 else s[:1] for s in stems})
    pattern = f"({EDGE_BEFORE}(?:{'|'.join(starts)})[\\p{{L}}\\p{{N}}]*)"
    text = texts.columns[0]
    vocabulary = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("word")).distinct()
    found = vocabulary.withColumn("stem", stemmed(F.col("word"))).where(F.col("stem").isin(stems)).collect()
    return {w: sorted({w, *(r["word"] for r in found if r["stem"] == stem(w))}) for w in wanted}
