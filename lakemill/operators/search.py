"""Full-text search over columns: words, phrases, OR and exclusion, ranked by how often and how near terms stand."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemmer import stem
from ..functions.text import EDGE_AFTER, STOP_WORDS, forms_of, joined, places, words
from ..types import ROW_ID, TEXT, UnknownColumn, column_types, safe_name
from .paging import PAGE_ROWS, Page

_BOOLEAN = re.compile(r"\b(?:AND|OR)\b")
_ITEM = re.compile(r'(-?)"([^"]*)"?|(-?)(\S+)')
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Query:
    """``kind`` is simple, phrase or boolean; ``terms`` are its words; a row matches if one of ``branches`` fits: every phrase in it, and none of its excluded ones."""

    kind: str
    terms: list[str]
    branches: list[list[tuple[bool, list[str]]]]


def parse_query(text: str, stop_words: frozenset[str] = STOP_WORDS) -> Query:
    """``word word`` (both), ``"a phrase"``, ``or``, ``-word``; ``and`` is a stop word. ValueError for an empty query."""
    text = (text or "").strip()
    if not text:
        raise ValueError("Search query cannot be empty")
    kind = "boolean" if _BOOLEAN.search(text) else "phrase" if '"' in text else "simple"
    terms = [t for t in re.sub(r'"', " ", text).split() if t not in ("AND", "OR")]
    branches: list[list[tuple[bool, list[str]]]] = [[]]
    for m in _ITEM.finditer(text):
        wanted, inner = not (m[1] or m[3]), m[2] if m[2] is not None else m[4]
        if m[2] is None and inner.lower() == "or" and wanted:
            branches.append([])
            continue
        found = _WORD.findall(inner.lower())
        if m[2] is None and len(found) == 1 or m[2] is not None or found:
            phrase = [w if w not in stop_words else "" for w in found]
            if any(phrase):
                branches[-1].append((wanted, phrase))
    return Query(kind, terms, [b for b in branches if b])


def query_words(query: Query) -> list[str]:
    """The words that a query looks for or excludes, each once."""
    return list(dict.fromkeys(w for b in query.branches for _, p in b for w in p if w))


def _starting(forms: list[str]) -> str:
    """Any of the words where no word goes on before it; the literal comes first, so that few places are looked at."""
    return "(?:" + "|".join(rf"{w}(?<![\p{{L}}\p{{N}}]{w})" for w in forms) + ")"


def _phrase(text: Column, phrase: list[str], forms: dict[str, list[str]]) -> Column:
    """Whether the words, in any of their forms, follow one another in a lower-case text; an empty one, a stop word, stands for any."""
    each = [forms.get(w, [w]) if w else None for w in phrase]
    while each and each[0] is None:
        each.pop(0)
    while each and each[-1] is None:
        each.pop()
    gap = r"[^\p{L}\p{N}]+"
    pattern = gap.join(r"[\p{L}\p{N}]+" if f is None else "(?:" + "|".join(f) + ")" for f in each[1:])
    fits = text.rlike(_starting(each[0]) + (gap + pattern if pattern else "") + EDGE_AFTER)
    for f in each:  # plain substrings first: most texts lack them
        if f is not None:
            fits = reduce(or_, (F.contains(text, F.lit(w)) for w in f)) & fits
    return fits


def match_column(text: Column, query: Query, forms: dict[str, list[str]] | None = None) -> Column:
    """Whether a lower-case text matches; ``forms`` has the words that count as a term. A query of stop words alone matches nothing."""
    fits = [reduce(and_, (_phrase(text, p, forms or {}) if wanted else ~_phrase(text, p, forms or {}) for wanted, p in sorted(b, key=lambda x: not x[0]))) for b in query.branches]
    return reduce(or_, fits) if fits else F.lit(False)


#: ``sum(1 / j**2)`` for j up to each number of occurrences that counts.
_SQUARES = list(accumulate(1.0 / (j * j) for j in range(1, 256)))


def _often(text: Column, forms: list[str]) -> Column:
    """``sum(0.1 / j**2)`` over a term's occurrences in a lower-case text, up to 255 of them."""
    n = F.regexp_count(text, F.lit(_starting(forms) + EDGE_AFTER))
    return F.when(n > 0, 0.1 * F.element_at(F.array(*map(F.lit, _SQUARES)), F.least(n, F.lit(255)))).otherwise(0.0)


def rank_column(text: Column, query: Query, forms: dict[str, list[str]] | None = None) -> Column:
    """Score of a matching lower-case text, between 0 and 1.

    One term, or alternatives: the mean over terms of ``sum(0.1 / j**2)`` over their occurrences, by pi**2 / 6. Several
    together: one less the product over pairs of places of ``1 - 0.1 * nearness``. Then ``s / (s + 1)``.
    """
    terms = query_words(query)
    if not terms:
        return F.lit(0.0)
    of = {w: (forms or {}).get(w, [w]) for w in terms}
    if len(terms) == 1 or len(query.branches) > 1:
        score = reduce(lambda a, b: a + b, (_often(text, of[w]) / 1.64493406685 for w in terms)) / len(terms)
        return score / (score + 1)
    return rank_places([F.transform(F.array(words(text)), lambda t: F.array(*(places(t, of[w]) for w in terms)))[0][i] for i in range(len(terms))])


def rank_places(at: list[Column]) -> Column:
    """The score of several terms together from the ascending places of each."""
    near = lambda d: F.when(d > 100, F.lit(1e-30)).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    far = lambda x, p, q: x * (1 - F.sqrt(0.01 * near(F.greatest(F.abs(p - q), F.lit(1)).cast("double"))))

    def with_term(b: Column):  # noqa: ANN202
        return lambda left, p: F.aggregate(b, left, lambda x, q: far(x, p, q))

    apart = F.lit(1.0)
    for i, a in enumerate(at):
        for b in at[:i]:
            apart = F.aggregate(a, apart, with_term(b))
    score = F.greatest(1 - apart, F.lit(1e-20))
    return score / (score + 1)


def _prepared(df: DataFrame, text: str, columns: list[str] | None, stop_words: frozenset[str], stems: bool) -> tuple[Query, Column, dict[str, list[str]]]:
    types = column_types(df)
    for c in columns or []:
        if safe_name(c) not in types:
            raise UnknownColumn(c)
    names = columns or [c for c, t in types.items() if t == TEXT] or list(types)
    query = parse_query(text, stop_words)
    low = F.lower(joined([F.col(f"`{c}`") for c in names]))
    return query, low, forms_of(df.select(low.alias("text")), query_words(query)) if stems and query.branches else {}


def _bound(low: Column, condition: Callable[[Column], Column]) -> Column:
    """A condition on a text that is made once, however often the condition names it."""
    return F.transform(F.array(low), condition)[0]


def matching_rows(df: DataFrame, text: str, columns: list[str] | None = None, stop_words: frozenset[str] = STOP_WORDS, stems: bool = True) -> DataFrame:
    """All matching rows as they are, in no order and without a score: one scan, nothing is ranked, sorted or shuffled."""
    query, low, forms = _prepared(df, text, columns, stop_words, stems)
    return df.where(_bound(low, lambda t: match_column(t, query, forms)))


def search(df: DataFrame, text: str, columns: list[str] | None = None, row_id: str = ROW_ID, stop_words: frozenset[str] = STOP_WORDS, stems: bool = True) -> DataFrame:
    """All matching rows with ``score``, best first, ties by row id. Columns: those asked for, else all texts, else all.

    With ``stems`` a term stands for all words with its English stem: one pass collects those words first. Rows that don't match are not ranked.
    """
    query, low, forms = _prepared(df, text, columns, stop_words, stems)
    found = df.where(_bound(low, lambda t: match_column(t, query, forms)))
    return found.withColumn("score", _bound(low, lambda t: rank_column(t, query, forms))).orderBy(F.desc("score"), row_id)


def search_page(df: DataFrame, text: str, columns: list[str] | None = None, page: int = 1, page_size: int = 20, row_id: str = ROW_ID, stems: bool = True) -> Page:
    """A page of :func:`search` with the number of all matches; only the page's query ranks. 1 to 100 rows a page."""
    if page < 1 or not 1 <= page_size <= PAGE_ROWS:
        raise ValueError(f"pages start at 1 and have 1 to {PAGE_ROWS} rows")
    query, low, forms = _prepared(df, text, columns, STOP_WORDS, stems)
    found = df.where(_bound(low, lambda t: match_column(t, query, forms)))
    ranked = found.withColumn("score", _bound(low, lambda t: rank_column(t, query, forms))).orderBy(F.desc("score"), row_id)
    return Page(found.count(), page, page_size, (ranked.offset((page - 1) * page_size) if page > 1 else ranked).limit(page_size))


def inverted_index(df: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """``(term, row_id, places)`` of one column: written bucketed or sorted by term, it serves single-column searches."""
    token = df.select(F.col(row_id), F.posexplode(words(F.col(f"`{safe_name(column)}`"))).alias("at", "term"))
    return token.groupBy("term", row_id).agg(F.array_sort(F.collect_list(F.col("at") + 1)).alias("places"))


#: Words that a task sorts at a time, and words whose stems it remembers, at most.
SORTED_WORDS, REMEMBERED = 1_000_000, 200_000


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(term, rows, places)`` of rows ``(row_id, words)``: a row per stem of so many words, with the rows that it stands in and its places in each."""
    known: dict[str, str] = {}
    for batch in batches:
        ends = batch.column("words").offsets.to_numpy().astype(np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + SORTED_WORDS, side="right")) - 1)
            ids, length = batch.column("row_id").slice(a, b - a), np.diff(ends[a : b + 1])
            coded = batch.column("words").slice(a, b - a).flatten().dictionary_encode()
            a = b
            if len(known) > REMEMBERED:
                known.clear()
            distinct = coded.dictionary.to_pylist()
            known.update((w, stem(w)) for w in distinct if w not in known)
            terms, number = np.unique(np.array([known[w] for w in distinct], object), return_inverse=True)
            term = number[coded.indices.to_numpy()]
            row, place = np.repeat(np.arange(len(length)), length), np.arange(len(term)) - np.repeat(np.cumsum(length) - length, length) + 1
            order = np.argsort(term, kind="stable")  # by term, row and place
            term, row, place = term[order], row[order], place[order]
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1]))) if len(term) else term
            of = pa.array(np.append(np.searchsorted(term[first], np.arange(len(terms))), len(first)), pa.int32())
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(term)), pa.int32()), pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.ListArray.from_arrays(of, ids.take(pa.array(row[first]))), pa.ListArray.from_arrays(of, places)], ["term", "rows", "places"])


class SearchIndex:
    """Postings of some columns by English stem, in a folder of Parquet files that searches read instead of the texts.

    ``(term, rows, places)``: each task that reads texts writes a file of its own, sorted by term, so nothing is shuffled and a search skips row groups and
    pages of other terms. A row holds a term's postings in some thousand rows at most.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._where.getFileSystem(spark._jsc.hadoopConfiguration())

    @property
    def exists(self) -> bool:
        return self._fs.exists(spark_path(self.spark, f"{self.path}/terms/_SUCCESS"))

    def drop(self) -> bool:
        """Whether there was one to delete."""
        return self._fs.delete(self._where, True)

    def build(self, df: DataFrame, columns: list[str], row_id: str = ROW_ID) -> SearchIndex:
        """Index the columns' joined texts; a complete index is kept as it is. Null texts have no postings, rows all count for exclusion."""
        if self.exists:
            return self
        self.drop()  # what an interrupted build left
        text = joined([F.col(f"`{safe_name(c)}`") for c in columns])
        rows = df.select(F.col(row_id).alias("row_id"), words(text).alias("words"))
        rows.select("row_id").write.mode("overwrite").parquet(f"{self.path}/rows")
        told = rows.mapInArrow(_postings, f"term string, rows array<{rows.schema['row_id'].dataType.simpleString()}>, places array<array<int>>")
        told.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/terms")
        return self

    def search(self, text: str, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
        """``(row_id, score)`` of all matching rows, best first, ties by row id: only postings of the query's terms are read."""
        if not self.exists:
            raise LookupError(f"no index at {self.path}")
        query = parse_query(text, stop_words)
        terms = list(dict.fromkeys(stem(w) for w in query_words(query)))
        if not terms:
            return self.spark.createDataFrame([], self.spark.read.parquet(f"{self.path}/rows").schema).withColumn("score", F.lit(0.0))
        kind = self.spark.read.parquet(f"{self.path}/rows").schema["row_id"].dataType.simpleString()
        found = self.spark.read.schema(f"term string, rows array<{kind}>, places array<array<int>>").parquet(f"{self.path}/terms").where(F.col("term").isin(terms))
        postings = found.select("term", F.explode(F.arrays_zip("rows", "places")).alias("one")).select("term", F.col("one.rows").alias("row_id"), F.col("one.places").alias("places"))
        # several rows of one id are one
        at = {t: F.array_sort(F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("places"))))).alias(f"p{i}") for i, t in enumerate(terms)}
        rows = postings.groupBy("row_id").agg(*at.values())
        if any(not any(wanted for wanted, _ in b) for b in query.branches):  # a branch that only excludes: rows without any term count
            rows = self.spark.read.parquet(f"{self.path}/rows").distinct().join(rows, "row_id", "left").select("row_id", *(F.coalesce(f"p{i}", F.array().cast("array<int>")).alias(f"p{i}") for i in range(len(terms))))
        column = {t: F.col(f"p{i}") for i, t in enumerate(terms)}

        def fits(phrase: list[str]) -> Column:
            known = [(k, column[stem(w)]) for k, w in enumerate(phrase) if w]
            begin, first = known[0]
            out = F.size(first) > 0
            for k, p in known[1:]:
                out &= F.size(p) > 0
            if len(known) == 1:
                return out
            return out & F.exists(first, lambda x: reduce(and_, (F.array_contains(p, x + (k - begin)) for k, p in known[1:])))

        match = reduce(or_, (reduce(and_, (fits(p) if wanted else ~fits(p) for wanted, p in b)) for b in query.branches))
        capped = [F.slice(F.transform(column[stem(w)], lambda p: F.least(p, F.lit(16383))), 1, 255) for w in query_words(query)]
        if len(capped) == 1 or len(query.branches) > 1:
            sums = [F.when(F.size(c) > 0, 0.1 * F.element_at(F.array(*map(F.lit, _SQUARES)), F.size(c))).otherwise(0.0) / 1.64493406685 for c in capped]
            score = reduce(lambda a, b: a + b, sums) / len(sums)
            score = score / (score + 1)
        else:
            score = rank_places(capped)
        return rows.where(match).select("row_id", score.alias("score")).orderBy(F.desc("score"), "row_id")


def spark_path(spark: SparkSession, path: str):  # noqa: ANN201
    return spark._jvm.org.apache.hadoop.fs.Path(path)
