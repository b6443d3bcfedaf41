"""Text and vector ranking: postings, BM25, keyword scores, fusion, cosine."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.functions.numbers import rounded
from codelattice.functions.paths import signature
from codelattice.functions.text import words_of
from codelattice.model import CodeGraph
from codelattice.operators.lookup import keyword_match
from codelattice.operators.ordering import rank_rows
from codelattice.session import stage

K1, B = 1.2, 0.75


def node_documents(g: CodeGraph) -> DataFrame:
    """The four indexed texts of a node as one document with a column tag per term."""
    sig = signature(F.col("kind"), F.col("name"), F.col("params"), F.col("return_type"))
    return g.nodes.select(
        F.col("qualified_name").alias("doc_id"),
        F.concat_ws(" ", "name", "qualified_name", "file_path", sig).alias("text"),
    )


def tokens(docs: DataFrame, stem: bool = False) -> DataFrame:
    """(doc_id, words, length) over whole texts."""
    words = words_of(F.col("text"))
    if stem:
        from codelattice.functions.stemming import stem_words

        words = stem_words(words)
    return docs.select("doc_id", words.alias("words")).withColumn("doc_len", F.size("words").cast("bigint"))


def postings(docs: DataFrame, stem: bool = False) -> DataFrame:
    """Inverted index rows (term, doc_id, tf, positions, doc_len)."""
    flat = tokens(docs, stem).select("doc_id", "doc_len", F.posexplode("words").alias("pos", "term"))
    return flat.groupBy("term", "doc_id", "doc_len").agg(
        F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")
    )


def _query_terms(query: str, stem: bool = False) -> list[str]:
    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    if stem:
        from codelattice.functions.stemming import porter_stem

        words = [porter_stem(w) for w in words]
    return words


def phrase_hits(docs: DataFrame, query: str, stem: bool = False) -> DataFrame:
    """(doc_id, doc_len, tf) of documents holding the words in sequence.

    Only the query's terms leave the tokeniser: each occurrence votes for the
    start position it implies, and a start with all votes is a phrase.
    """
    terms = _query_terms(query, stem)
    if not terms:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("doc_len"), F.lit(0).cast("bigint").alias("tf")).limit(0)
    flat = tokens(docs, stem).select("doc_id", "doc_len", F.posexplode("words").alias("pos", "term"))
    flat = flat.where(F.col("term").isin(*terms))
    slots = F.array(*[F.when(F.col("term") == t, F.lit(i)) for i, t in enumerate(terms)])
    votes = flat.select("doc_id", "doc_len", "pos", F.explode(F.array_compact(slots)).alias("slot"))
    starts = votes.groupBy("doc_id", "doc_len", (F.col("pos") - F.col("slot")).alias("start")).agg(
        F.count("*").alias("n")
    )
    return starts.where(F.col("n") == len(terms)).groupBy("doc_id", "doc_len").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return tokens(docs).agg(F.count("*").alias("docs"), F.avg("doc_len").alias("avg_len"))


def bm25(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Okapi BM25 of phrase hits.

    The hits are found once; the corpus count and mean length come from one
    pass, as one scalar subquery.
    """
    hits = stage(hits, "hits")
    corpus = tokens(docs).agg(
        F.struct(F.count("*").cast("double").alias("n"), F.avg("doc_len").alias("avg_len")).alias("stats")
    ).scalar()
    n, avg_len = corpus["n"], corpus["avg_len"]
    df = hits.agg(F.count("*").cast("double")).scalar()
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    tf = F.col("tf").cast("double")
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / avg_len))
    return hits.select("doc_id", "tf", "doc_len", (idf * weight).alias("score"))


def phrase_search(docs: DataFrame, query: str, limit: int | None = 50, stem: bool = False) -> DataFrame:
    scored = bm25(phrase_hits(docs, query, stem), docs)
    return scored if limit is None else scored.orderBy(F.desc("score"), "doc_id").limit(limit)


def term_search(docs: DataFrame, query: str) -> DataFrame:
    """Documents holding every term."""
    terms = sorted(set(_query_terms(query)))
    words = tokens(docs)
    hit = F.lit(bool(terms))
    for t in terms:
        hit = hit & F.array_contains("words", t)
    return words.where(hit).select("doc_id", "doc_len")


def keyword_scores(g: CodeGraph, query: str) -> DataFrame:
    """AND match scored 3 exact, 2 prefix, 1 contains (scored before any cut)."""
    return g.nodes.where(keyword_match(query)).select(
        F.col("qualified_name").alias("doc_id"), keyword_score(query).alias("score")
    )


def keyword_score(query: str) -> Column:
    q = query.lower()
    return F.when(F.lower("name") == q, 3.0).when(F.lower("name").startswith(q), 2.0).otherwise(1.0)


def kind_boosts(query: str) -> dict[str, float]:
    """Boost factors implied by the shape of a query."""
    text = (query or "").strip()
    boosts: dict[str, float] = {}
    if len(text) > 1 and "A" <= text[0] <= "Z" and "a" <= text[1] <= "z":
        boosts.update({"Class": 1.5, "Type": 1.5})
    if "_" in text and any(c.isascii() and c.isalpha() for c in text):
        boosts["Function"] = 1.5
    if "." in text:
        boosts["_qualified"] = 2.0
    return boosts


def fuse(lists: list[DataFrame], k: int = S.RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (doc_id, score).

    A limit cuts each list to its top rows, which are then numbered in one
    small window; whole lists are numbered by the many-task ranking.
    """
    parts = []
    order = [F.desc("score"), F.asc("doc_id")]
    for ranked in lists:
        top = ranked.select("doc_id", "score")
        if limit is not None:
            top = top.orderBy(*order).limit(limit)
            placed = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
        else:
            placed = rank_rows(top.withColumn("list", F.lit(0)), ["list"], order, "place").withColumn(
                "place", F.col("place") + 1
            )
        parts.append(placed.select("doc_id", (F.lit(1.0) / (F.lit(k) + F.col("place"))).alias("part")))
    merged = parts[0]
    for more in parts[1:]:
        merged = merged.unionByName(more)
    return merged.groupBy("doc_id").agg(F.sum("part").alias("score"))


def boost_factor(query: str, context_files: list[str] | None = None) -> Column:
    """What a node's score is multiplied with: kinds and names the query's shape asks for, files at hand."""
    boosts = kind_boosts(query)
    factor = F.lit(1.0)
    for word in ("Class", "Type", "Function"):
        if word in boosts:
            factor = factor * F.when(F.col("kind") == word, boosts[word]).otherwise(1.0)
    if "_qualified" in boosts:
        factor = factor * F.when(F.lower("qualified_name").contains(query.lower()), boosts["_qualified"]).otherwise(1.0)
    if context_files:
        factor = factor * F.when(F.col("file_path").isin(*context_files), 1.5).otherwise(1.0)
    return factor


def hybrid_search(
    g: CodeGraph, query: str, kind: str | None = None, limit: int = S.SEARCH_LIMIT,
    context_files: list[str] | None = None, vectors: DataFrame | None = None,
    query_vector: Sequence[float] | None = None, index=None,
) -> DataFrame:
    """Phrase and vector lists fused, then boosted; the kind filter comes after ranking.

    With a stored ``index`` (``sinks.search_index``) of the nodes only its postings are read for the phrase.
    """
    if not query.strip():
        return g.nodes.select("qualified_name", "kind", "file_path", F.lit(0.0).alias("score")).limit(0)
    fetch = limit * 3
    lists = [phrase_search(node_documents(g), query, fetch) if index is None else index.phrase_search(query, fetch, across=True)]
    if vectors is not None and query_vector is not None:
        lists.append(cosine_top(vectors, query_vector, fetch))
    merged = fuse([d for d in lists if not d.isEmpty()] or [lists[0]], limit=fetch)
    if merged.isEmpty():
        merged = keyword_scores(g, query).orderBy(F.desc("score"), "doc_id").limit(fetch)
    factor = boost_factor(query, context_files)
    found = merged.withColumnRenamed("doc_id", "qualified_name").join(
        g.nodes.select("qualified_name", "kind", "file_path"), "qualified_name"
    )
    if kind:
        found = found.where(F.col("kind") == kind)
    ranked = found.withColumn("boosted", F.col("score") * factor)
    return ranked.orderBy(F.desc("boosted"), "qualified_name").limit(limit).select(
        "qualified_name", "kind", "file_path", rounded(F.col("boosted"), 6).alias("score")
    )


def cosine_scores(query: Sequence[float]):
    """A vectorised scorer: cosine to the query, 0 for other lengths or a zero norm."""
    q = np.asarray(query, dtype=np.float64)
    q_norm = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors))
        fit = np.array([v is not None and len(v) == len(q) for v in vectors], dtype=bool)
        if fit.any() and q_norm > 0:
            m = np.stack(vectors[fit].to_numpy()).astype(np.float64)
            norms = np.sqrt(np.einsum("ij,ij->i", m, m)) * q_norm
            out[fit] = np.divide(m @ q, norms, out=np.zeros(len(m)), where=norms > 0)
        return pd.Series(out)

    return score


def cosine_top(vectors: DataFrame, query: Sequence[float], limit: int | None = S.SEARCH_LIMIT) -> DataFrame:
    """(doc_id, score) by cosine to one query vector; a top-k, no full sort."""
    scored = vectors.select("doc_id", cosine_scores(query)(F.col("vector")).alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("score"), "doc_id").limit(limit)


def node_text(g: CodeGraph) -> DataFrame:
    """Text a node is embedded by."""
    return g.nodes.select(
        F.col("qualified_name").alias("doc_id"),
        F.concat_ws(
            " ", "name",
            F.when(F.col("kind") != "File", F.lower("kind")),
            F.when(F.coalesce("parent_name", F.lit("")) != "", F.concat(F.lit("in "), F.col("parent_name"))),
            F.when(F.coalesce("params", F.lit("")) != "", F.col("params")),
            F.when(F.coalesce("return_type", F.lit("")) != "", F.concat(F.lit("returns "), F.col("return_type"))),
            F.when(F.coalesce("language", F.lit("")) != "", F.col("language")),
        ).alias("text"),
    )


def letter_vector(text: Column) -> Column:
    """Deterministic offline embedding: counts of the letters a–z."""
    low = F.lower(text)
    return F.transform(
        F.sequence(F.lit(97), F.lit(122)),
        lambda c: (F.length(low) - F.length(F.replace(low, F.char(c), F.lit("")))).cast("float"),
    )


def embed(texts: DataFrame, provider: str = "letters", encode=None) -> DataFrame:
    """(doc_id, text_hash, provider, vector); ``encode`` is a pandas UDF for a real model."""
    vector = letter_vector(F.col("text")) if encode is None else encode(F.col("text"))
    return texts.select("doc_id", F.sha2("text", 256).alias("text_hash"), F.lit(provider).alias("provider"), vector.alias("vector"))


def refresh_embeddings(stored: DataFrame, texts: DataFrame, provider: str = "letters", encode=None) -> DataFrame:
    """Embed only texts whose hash or provider changed; keep the other vectors."""
    hashed = texts.withColumn("text_hash", F.sha2("text", 256))
    same = stored.where(F.col("provider") == provider).select("doc_id", "text_hash")
    todo = hashed.join(same, ["doc_id", "text_hash"], "left_anti")
    fresh = embed(todo.select("doc_id", "text"), provider, encode)
    kept = stored.join(todo.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(fresh)


def cross_repo_search(index, nodes: DataFrame, query: str, kind: str | None = None, limit: int = S.SEARCH_LIMIT) -> DataFrame:
    """Hybrid search in every repository of an index at once, merged by score.

    ``nodes`` has a ``repo`` column. Each repository ranks its own phrase hits, or its keyword matches where it has
    none; the windows keep a few rows per repository, which Spark cuts in every task before it shuffles.
    """
    fetch = limit * 3
    best = Window.partitionBy("repo").orderBy(F.desc("score"), "qualified_name")
    place = F.row_number().over(best)
    about = nodes.select("repo", "qualified_name", "kind", "file_path", "name")
    hits = index.phrase_search(query, None).select("repo", F.col("doc_id").alias("qualified_name"), "score")
    ranked = hits.withColumn("place", place).where(F.col("place") <= fetch).select("repo", "qualified_name", (F.lit(1.0) / (F.lit(S.RRF_K) + F.col("place"))).alias("score"))
    words = about.where(keyword_match(query)).join(hits.select("repo").distinct(), "repo", "left_anti")
    words = words.select("repo", "qualified_name", keyword_score(query).alias("score"))
    words = words.withColumn("place", place).where(F.col("place") <= fetch).drop("place")
    found = ranked.unionByName(words).join(about, ["repo", "qualified_name"])
    if kind:
        found = found.where(F.col("kind") == kind)
    boosted = found.withColumn("score", F.col("score") * boost_factor(query))
    top = boosted.withColumn("place", place).where(F.col("place") <= limit)
    return top.select("qualified_name", "kind", "file_path", rounded(F.col("score"), 6).alias("score"), "repo").orderBy(
        F.desc("score"), "repo", "qualified_name").limit(limit)
