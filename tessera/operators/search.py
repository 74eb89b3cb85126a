"""Full-text search over a postings table: token, fuzzy, phonetic and boolean queries, BM25 order, paging."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.similarity import soundex

K1, B = 1.2, 0.75


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, token, key, tf, size (tokens of that field): a table to be written, partitioned by field."""
    rows = docs.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(f).alias("all")) for f in fields])).alias("x"))
    return rows.select(key, "x.field", F.size("x.all").alias("size"), F.explode("x.all").alias("token")).groupBy("field", "token", key, "size").agg(F.count(F.lit(1)).alias("tf"))


def parse(query: str) -> list[tuple[str, str]]:
    """(must, should or not, token) of a query with AND, OR, NOT, + and -; anything unparsable is plain tokens."""
    out, mode = [], "should"
    for word in re.findall(r"\S+", query):
        if word in ("AND", "OR", "NOT"):
            if word == "AND" and out and out[-1][0] == "should":
                out[-1] = ("must", out[-1][1])
            mode = {"AND": "must", "OR": "should", "NOT": "not"}[word]
            continue
        if word[0] in "+-":
            mode, word = ("must" if word[0] == "+" else "not"), word[1:]
        out += [(mode, t) for t in re.findall(r"[^\W_]+", word.lower())]
        mode = "should"
    return out


def bm25(index: DataFrame, terms: list[str], key: str) -> DataFrame:
    """key, score over all fields for the given terms; fixed k1 and b."""
    hits = index.where(F.col("token").isin(terms))
    of = index.groupBy("field").agg(F.countDistinct(key).alias("n"), (F.sum("tf") / F.countDistinct(key)).alias("mean"))
    df = hits.groupBy("field", "token").agg(F.countDistinct(key).alias("df"))
    rows = hits.join(F.broadcast(of), "field").join(F.broadcast(df), ["field", "token"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return rows.groupBy(key).agg(F.sum(idf * tf).alias("score"))


def matches(index: DataFrame, query: str, key: str) -> DataFrame:
    """key, score of all documents that a boolean query finds, in no order."""
    wanted = parse(query)
    must, no = {t for m, t in wanted if m == "must"}, {t for m, t in wanted if m == "not"}
    terms = sorted({t for m, t in wanted if m != "not"})
    found = bm25(index, terms, key)
    if must:
        has = index.where(F.col("token").isin(sorted(must))).groupBy(key).agg(F.countDistinct("token").alias("n")).where(F.col("n") == len(must))
        found = found.join(has.select(key), key, "left_semi")
    if no:
        found = found.join(index.where(F.col("token").isin(sorted(no))).select(key).distinct(), key, "left_anti")
    return found


def search(index: DataFrame, query: str, key: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """key, score, rank, total of a page, best first."""
    return page(matches(index, query, key), key, limit, offset)


def page(found: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """The rows behind ``offset`` of the best ``offset + limit``, with rank and the total."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    top = found.orderBy(F.desc("score"), key).limit(offset + limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # offset + limit rows
    return ranked.where(F.col("rank") > offset).crossJoin(F.broadcast(total))


def edit_bound(term: Column) -> Column:
    """Edits allowed by length: none to 2 characters, one to 5, two beyond."""
    n = F.char_length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def fuzzy_terms(index: DataFrame, words: list[str], most: int | None = None) -> DataFrame:
    """term, token: dictionary tokens near each word. Runs on distinct tokens, not on documents."""
    dictionary = index.select("token").distinct()
    near = [F.when(F.levenshtein(F.col("token"), F.lit(w), most if most is not None else 2) >= 0, F.when(F.levenshtein("token", F.lit(w)) <= (F.lit(most) if most is not None else edit_bound(F.lit(w))), F.lit(w))) for w in words]
    return dictionary.select("token", F.explode(F.array_compact(F.array(*near))).alias("term"))


def fuzzy(index: DataFrame, text: str, key: str, most: int | None = None) -> DataFrame:
    """key, hits: documents with a token near some word, and the number of words found."""
    words = re.findall(r"[^\W_]+", text.lower())
    return index.join(fuzzy_terms(index, words, most), "token").groupBy(key).agg(F.countDistinct("term").alias("hits"))


def sounds_like(index: DataFrame, text: str, key: str) -> DataFrame:
    """key of documents with a token of the same Soundex code as some word."""
    words = re.findall(r"[A-Za-z]+", text)
    codes = reduce(Column.__or__, [soundex("token") == soundex(F.lit(w)) for w in words], F.lit(False))
    return index.join(index.select("token").distinct().where(codes), "token", "left_semi").select(key).distinct()


def candidates(index: DataFrame, text: str, key: str, identifiers: DataFrame | None = None) -> DataFrame:
    """Union of fuzzy, phonetic and identifier hits."""
    found = fuzzy(index, text, key).select(key).unionByName(sounds_like(index, text, key))
    return (found if identifiers is None else found.unionByName(identifiers.select(key))).distinct()


def reindex(index: DataFrame, changed: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """The postings without changed and deleted documents, with the changed ones' new rows."""
    gone = changed.select(key).unionByName(deleted.select(key)).distinct()
    return index.join(gone, key, "left_anti").unionByName(changed)


def date_range(df: DataFrame, column: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Both ends included, either open."""
    if since:
        df = df.where(F.col(column) >= F.lit(since).cast("date"))
    return df.where(F.col(column) <= F.lit(until).cast("date")) if until else df


def boosted(index: DataFrame, text: str, boosts: DataFrame, key: str, weight: float) -> DataFrame:
    """key, score of documents that hold all words of a text; ``boosts`` (key, boost) adds ``weight`` but finds nothing by itself."""
    found = matches(index, " ".join(f"+{w}" for w in re.findall(r"[^\W_]+", text)), key)
    return found.join(boosts, key, "left").select(key, (F.col("score") + F.when(F.col("boost"), weight).otherwise(0.0)).alias("score"))


def unmasked_matches(index: DataFrame, masked: DataFrame, open_fields: list[str], query: str, key: str) -> DataFrame:
    """:func:`matches` over what a reader sees: of ``masked`` documents the open fields alone."""
    hidden = masked.select(key).withColumn("__masked", F.lit(True))
    seen = index.join(hidden, key, "left").where(F.col("__masked").isNull() | F.col("field").isin(open_fields)).drop("__masked")
    return matches(seen, query, key)


def stats(index: DataFrame, key: str) -> DataFrame:
    """By field: documents, distinct tokens and postings."""
    return index.groupBy("field").agg(F.countDistinct(key).alias("documents"), F.countDistinct("token").alias("tokens"), F.count(F.lit(1)).alias("postings"))
