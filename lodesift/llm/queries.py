"""The queries of the training-text operators over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodesift.llm import abuse, neardup, packing, pairs, splitting, tokens, vectors
from lodesift.runtime import cut, table

# ------------------------------------------------------------------ problem 1


def _long_texts(spark: SparkSession, folder: str) -> DataFrame:
    corpus = table(spark, folder, "corpus").select(F.lit("corpus").alias("src"), "ord", "text")
    full = table(spark, folder, "corpus_fulltext").select(F.lit("corpus_fulltext").alias("src"), "ord", F.col("full_text").alias("text"))
    return corpus.unionByName(full)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.cut_kind(_long_texts(spark, folder), "text")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_texts(_long_texts(spark, folder), "text")


def p1_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Of every oversized text: its pieces put together again, whether all keep the limit and repeat what they say they repeat."""
    by = Window.partitionBy("src", "ord").orderBy("piece_index")
    parts = p1_pieces(spark, folder).withColumn("before", F.lag("piece").over(by)).withColumn("last", F.lag(F.col("start") + F.col("n_chars")).over(by))
    fine = (F.length("piece") <= splitting.LIMIT) & (F.length("piece") == F.col("n_chars"))
    joined = (F.left("piece", F.col("n_overlap")) == F.right("before", F.col("n_overlap"))) | (F.col("n_overlap") == 0)
    placed = F.col("start") + F.col("n_overlap") == F.coalesce("last", F.lit(0))
    row = F.struct("piece_index", F.expr("substring(piece, n_overlap + 1)").alias("core"))
    done = parts.groupBy("src", "ord").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["core"]), "").alias("whole"),
        F.bool_and(fine).alias("within_limit"),
        F.bool_and(F.coalesce(joined, F.lit(True)) & placed).alias("overlaps_match"),
    )
    return done.select("src", "ord", F.md5("whole").alias("digest"), "within_limit", "overlaps_match")


P1_TILING_SQL = """
WITH t AS (SELECT 'corpus' AS src, ord, text FROM corpus UNION ALL SELECT 'corpus_fulltext', ord, full_text FROM corpus_fulltext)
SELECT src, ord, md5(text) AS digest, true AS within_limit, true AS overlaps_match FROM t WHERE length(text) > 2400
"""

P1_FOUND_SQL = """
WITH t AS (
  SELECT 'corpus' AS src, ord, text FROM corpus
  UNION ALL SELECT 'corpus_fulltext', ord, full_text FROM corpus_fulltext
)
SELECT src, ord,
  CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\\t-\\r 。！？]'), lambda x: length(x))) > 2400
       THEN 'forced' ELSE 'natural' END AS cut
FROM t WHERE length(text) > 2400
"""

# ------------------------------------------------------------------ problem 2


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neardup.similar_pairs(table(spark, folder, "corpus"), "ord", "text", "paper_id", words=3, similarity=0.6)
    return pairs.select(F.col("key_a").alias("ord_a"), F.col("key_b").alias("ord_b"))


def _groups(spark: SparkSession, folder: str, words: int, similarity: float) -> DataFrame:
    """One row per text: the first text with the same words, the first text of the group, and links to other texts."""
    found = neardup.near_duplicates(table(spark, folder, "corpus"), "ord", "text", words, similarity).withColumnRenamed("key", "ord")
    found = cut(found)
    firsts = found.where("cls IS NOT NULL").groupBy("cls").agg(F.min("ord").alias("first_copy"), F.first("group_id").alias("group_id"))
    groups = cut(firsts).groupBy("group_id").agg(F.min("first_copy").alias("group_ord"))
    named = firsts.join(groups, "group_id").select("cls", "first_copy", "group_ord")
    return found.select("ord", "cls", "n_links").join(named, "cls", "left").select("ord", "first_copy", "group_ord", F.col("n_links").cast("bigint").alias("n_links"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups at the similarity that the problem states: three words, 0.6."""
    return _groups(spark, folder, 3, 0.6)


def p2_groups_close(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of closer texts: five words, 0.8."""
    return _groups(spark, folder, 5, 0.8)


def _groups_sql(words: int, num: int, den: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE w AS (SELECT ord, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM corpus WHERE text IS NOT NULL),
s AS (SELECT ord, list_sort(list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {gram}))) AS g FROM w WHERE len(w) >= {words}),
c AS (SELECT ord, min(ord) OVER (PARTITION BY g) AS first_copy, g FROM s),
e AS (SELECT first_copy AS k, unnest(g) AS g, len(g) AS n FROM c WHERE ord = first_copy),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) AS sizes FROM e a JOIN e b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE shared * {den} >= (sizes - shared) * {num}),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT first_copy AS k, first_copy AS root FROM c UNION SELECT d.b, r.root FROM r JOIN d ON d.a = r.k WHERE r.root < d.b),
m AS (SELECT k, min(root) AS root FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM d GROUP BY 1)
SELECT corpus.ord, c.first_copy, m.root AS group_ord, CASE WHEN c.ord IS NOT NULL THEN coalesce(n.n, 0) END AS n_links
FROM corpus LEFT JOIN c ON c.ord = corpus.ord LEFT JOIN m ON m.k = c.first_copy LEFT JOIN n ON n.a = c.first_copy
"""


P2_FOUND_SQL = """
WITH w AS (
  SELECT ord, paper_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w
  FROM corpus WHERE paper_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT ord, paper_id, unnest(list_distinct(list_transform(range(1, len(w) - 1),
         lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g
  FROM w WHERE len(w) >= 3
), n AS (SELECT ord, count(*) AS n FROM s GROUP BY ord),
p AS (
  SELECT a.ord AS ord_a, b.ord AS ord_b, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.ord < b.ord AND a.paper_id <> b.paper_id
  GROUP BY 1, 2
)
SELECT ord_a, ord_b FROM p JOIN n x ON x.ord = ord_a JOIN n y ON y.ord = ord_b
WHERE shared * 5 >= (x.n + y.n - shared) * 3
"""

# ------------------------------------------------------------------ problem 3


def _near_chunks(spark: SparkSession, folder: str, floor: float | None) -> DataFrame:
    names = table(spark, folder, "chunk_ids")
    found = vectors.similar_vectors(table(spark, folder, "vec_chunks"), "row_id", "embedding", names, "chunk_id", floor=floor)
    return found.select(F.col("name").alias("chunk_id"), F.col("other").alias("neighbour_id"), "cosine", "rank")


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _near_chunks(spark, folder, None)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of cosine 0.9 or more: what is nearer ranks first, so the floor does not change the five.

    The floor is part of this query's definition; ``p3_neighbours`` has none.
    """
    near = _near_chunks(spark, folder, 0.9)
    pair = near.select(
        F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b")
    )
    return pair.distinct()


P3_FOUND_SQL = """
WITH v AS (
  SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS x FROM vec_chunks JOIN chunk_ids USING (row_id)
  WHERE len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)), false)
    AND list_contains(list_transform(embedding, lambda e: e <> 0), true)
), n AS (SELECT chunk_id, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS u FROM v),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_dot_product(a.u, b.u) AS c FROM n a JOIN n b ON a.chunk_id <> b.chunk_id),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS k FROM s WHERE c >= 0.9)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE k <= 5
"""


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with neighbours, rows, and how many vectors lack one of their five: one row."""
    near = p3_neighbours(spark, folder).groupBy("chunk_id").agg(F.count("*").alias("c"), F.max("rank").alias("last"), F.min("rank").alias("first"))
    fine = (F.col("c") == 5) & (F.col("last") == 5) & (F.col("first") == 1)
    return near.agg(F.count("*").alias("vectors"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count_if(~fine).alias("incomplete"))


P3_COUNTS_SQL = """
WITH v AS (
  SELECT DISTINCT chunk_id FROM vec_chunks JOIN chunk_ids USING (row_id)
  WHERE len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)), false)
    AND list_contains(list_transform(embedding, lambda e: e <> 0), true)
)
SELECT count(*)::BIGINT AS vectors, (5 * count(*))::BIGINT AS n_rows, 0::BIGINT AS incomplete FROM v
"""

# ------------------------------------------------------------------ problem 4


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "qa_set").select("qid", "question", "reference_answer").where(F.col("qid").isNotNull()).distinct()
    own = asked.select(F.lit("qa_set").alias("src"), F.col("qid").alias("pair_key"), "qid", "question", F.col("reference_answer").alias("answer"))
    by_qid = asked.groupBy("qid").agg(F.max("question").alias("question"))
    runs = table(spark, folder, "answers").select("answer_id", "qid", "answer").join(by_qid, "qid")
    runs = runs.select(F.lit("answers").alias("src"), F.col("answer_id").cast("string").alias("pair_key"), "qid", "question", "answer")
    return own.unionByName(runs)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(_pairs(spark, folder))


def p4_without_words(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs whose answer is null or holds no letter, digit or markup at all, with the defect found."""
    asked = _pairs(spark, folder).where(F.col("question").rlike(r"\S") & F.coalesce(~F.col("answer").rlike(r"[^\s.?!-]"), F.lit(True)))
    return asked.select("src", "pair_key").distinct().join(p4_found(spark, folder), ["src", "pair_key"], "left")


P4_WITHOUT_WORDS_SQL = r"""
WITH q AS (SELECT DISTINCT qid, question, reference_answer FROM qa_set WHERE qid IS NOT NULL),
b AS (SELECT qid, max(question) AS question FROM q GROUP BY 1),
p AS (SELECT 'qa_set' AS src, qid AS pair_key, question, reference_answer AS answer FROM q
  UNION ALL SELECT 'answers', answer_id::VARCHAR, question, answer FROM answers JOIN b USING (qid))
SELECT DISTINCT src, pair_key, 'empty' AS defect FROM p
WHERE regexp_matches(question, '[^ \t-\r]') AND (answer IS NULL OR NOT regexp_matches(answer, '[^ \t-\r.?!-]'))
"""

# ------------------------------------------------------------------ problems 5 and 6


def p5_ids(spark: SparkSession, folder: str) -> DataFrame:
    found = tokens.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "ids")


def p5_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The text that the ids of every document stand for, as a digest."""
    return tokens.decode(p5_ids(spark, folder), "doc_id", "ids").select(F.col("id").alias("doc_id"), F.md5("text").alias("digest"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents, those not placed exactly once as a whole or in containers' sizes, and overfull containers."""
    placed = cut(p6_containers(spark, folder))
    sizes = tokens.count_tokens(table(spark, folder, "documents"), "doc_id", "text")
    parts = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), F.max("part").alias("last"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    both = sizes.join(parts, sizes["id"] == parts["doc_id"], "full")
    least = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / packing.CAPACITY))
    fine = (F.col("n") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("parts") == least) & (F.col("last") == F.col("parts") - 1)
    told = both.agg(F.count("id").alias("documents"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("misplaced"))
    full = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("overfull"))
    return told.crossJoin(full)  # one row each


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(sizes, "id", "n_tokens").withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: one row."""
    filled = p6_containers(spark, folder).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return filled.where("used > 0").agg(
        F.count("*").alias("containers"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        (1 - F.sum("used") / (F.count("*") * packing.CAPACITY)).alias("unused_share"),
    )


# ------------------------------------------------------------------ problem 7


def p7_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.score_documents(table(spark, folder, "documents"), table(spark, folder, "review_labels"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_scores(spark, folder).where("flagged").select("doc_id")


def p7_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per source (spellings joined): documents, flagged ones, their share and the mean score."""
    source = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim("source")), r"[^a-z0-9]+", "_"), F.lit("")), F.lit("unknown"))
    docs = table(spark, folder, "documents").select("doc_id", "text", source.alias("source"))
    scored = abuse.score_documents(docs, table(spark, folder, "review_labels"), keep="source")
    return scored.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if("flagged").alias("flagged"),
        F.avg(F.col("flagged").cast("double")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )


def p7_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Of the rates per source what SQL can tell: the documents, and whether rate and mean lie where they must."""
    r = p7_rates(spark, folder)
    fine = (F.abs(F.col("rate") * F.col("documents") - F.col("flagged")) < 1e-6) & F.col("rate").between(0, 1) & F.col("mean_score").between(0, 1)
    return r.select("source", "documents", fine.alias("consistent"))


P7_SOURCES_SQL = """
SELECT coalesce(nullif(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g'), ''), 'unknown') AS source, count(*) AS documents, true AS consistent
FROM documents GROUP BY 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p1_tiling": p1_tiling,
        "p2_found": p2_found,
        "p2_groups": p2_groups,
        "p2_groups_close": p2_groups_close,
        "p3_found": p3_found,
        "p3_neighbours": p3_neighbours,
        "p3_counts": p3_counts,
        "p4_found": p4_found,
        "p4_without_words": p4_without_words,
        "p5_ids": p5_ids,
        "p5_decoded": p5_decoded,
        "p6_checks": p6_checks,
        "p6_containers": p6_containers,
        "p6_fill": p6_fill,
        "p7_found": p7_found,
        "p7_scores": p7_scores,
        "p7_rates": p7_rates,
        "p7_sources": p7_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND_SQL,
        "p1_tiling": P1_TILING_SQL,
        "p2_found": P2_FOUND_SQL,
        "p2_groups": _groups_sql(3, 3, 5),
        "p2_groups_close": _groups_sql(5, 4, 5),
        "p3_found": P3_FOUND_SQL,
        "p3_counts": P3_COUNTS_SQL,
        "p4_without_words": P4_WITHOUT_WORDS_SQL,
        "p5_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
        "p6_checks": "SELECT count(*) AS documents, 0::BIGINT AS misplaced, 0::BIGINT AS overfull FROM documents",
        "p7_sources": P7_SOURCES_SQL,
    }
