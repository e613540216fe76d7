"""The registered queries of the numbered operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import byte_bpe, embedding_dedup, language_id, lm_scoring, neighbours, ngram_join, packing, quality, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def remainder(column: str, n: int) -> Column:
    """crc32 of the number as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is good, by its text and by its source and language."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 5-word runs are alike at 0.75 or more."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


_REACHED = """SELECT node, min(root) AS component_id FROM (
  WITH RECURSIVE reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node) SELECT * FROM reach
) GROUP BY node"""
ORACLES["op2_ngram_join"] = f"""
WITH words AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words
), items AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM items x JOIN items y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * k >= 75 * (len(x.s) + len(y.s) - k)
), nodes AS (SELECT doc_id AS node FROM sets), reached AS ({_REACHED})
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN reached ON node = doc_id
"""
ORACLES["op7_embedding_dedup"] = f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v, embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding]) AS fine FROM embeddings
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id <> y.vec_id AND x.fine AND y.fine AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), nodes AS (SELECT vec_id AS node FROM vectors), reached AS ({_REACHED}), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM vectors JOIN reached ON node = vec_id LEFT JOIN n ON a = vec_id
"""


def tokenizer_file(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:  # of the driver's own installation; tasks get its bytes
        return f.read()


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to, as digests."""
    import public_tokenizers

    bpe = byte_bpe.PrefixBpe.from_rank_file(tokenizer_file("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode_texts(table(spark, sf_dir, "documents"), bpe, public_tokenizers.PATTERN, with_ids=False)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


SITE_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    rules = [url_filter.site_rule(*r) for r in SITE_RULES] + list(url_filter.DEFAULT_RULES)
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


_WORDS = "|".join(url_filter.BLOCKED_WORDS)
ORACLES["op5_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM split
), rules AS (
  SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in SITE_RULES)}) AS t(verdict, rule, rule_host, rule_path)
), fitting AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS nth
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])({_WORDS})([^A-Za-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM fitting WHERE nth = 1
"""


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose remainder is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(remainder("doc_id", 4) != 2), id_col="doc_id")
    out = language_id.with_language(docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors at a cosine of 0.95 or more."""
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents, learnt from those whose remainder is not 0."""
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


@query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all rows to each whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document, by the pieces of ``piece_bpe_32k.model``."""
    import public_tokenizers

    automaton = token_counts.LongestMatch(*token_counts.pieces_of_model(public_tokenizers.path("piece_bpe_32k.model")))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), automaton)
