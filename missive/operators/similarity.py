"""Relational TF-IDF and cosine joins over normalized text.

Vectors are long tables (id, term, w). Pairs come from equi-joins on terms; with a threshold,
only each vector's rarest terms are joined: those without which the rest of the vector cannot
reach the threshold (prefix filtering). Survivors are then summed exactly. The k best matches come from
term lists in blocks, of which each query joins only those that may still beat its k-th best score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.functions.text import normalized_content, placeholders
from missive.sources.scratch import written

WORDS_CAP, CHARS_CAP = 25_000, 40_000
SCORE_PLACES = 9


def _known(rows: DataFrame, vocab: DataFrame | None) -> DataFrame:
    """The rows whose term is in vocab, which is bounded by a cap; all of them without one."""
    return rows if vocab is None else rows.join(F.broadcast(vocab.select("term")), "term", "left_semi")


def words_of(text: Column) -> Column:
    """The words of two or more characters of normalized text, in order."""
    return F.filter(F.split(normalized_content(text), " "), lambda w: F.length(w) >= 2)


def words_and_pairs(words: str) -> Column:
    """The words of a column of words, and pairs of neighbours."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1)))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def word_terms(df: DataFrame, text: Column, vocab: DataFrame | None = None) -> DataFrame:
    """id, term, tf: words of two or more characters, and pairs of neighbours; only those of vocab, if there is one."""
    rows = df.select("id", words_of(text).alias("w"))
    return _known(rows.select("id", F.explode(words_and_pairs("w")).alias("term")), vocab).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def char_terms(df: DataFrame, text: Column, vocab: DataFrame | None = None) -> DataFrame:
    """id, term, tf: grams of 3 to 5 characters inside blank-padded words; only those of vocab, if there is one."""
    words = df.select("id", F.explode(F.filter(F.split(normalized_content(text), " "), lambda w: w != "")).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"))
    words = words.withColumn("w", F.concat(F.lit(" "), "w", F.lit(" "))).withColumn("l", F.length("w"))
    grams = F.flatten(F.transform(F.sequence(F.lit(3), F.least(F.lit(5), F.col("l"))), lambda n: F.transform(F.sequence(F.lit(1), F.col("l") - n + 1), lambda i: F.substr(F.col("w"), i, n))))
    return _known(words.select("id", "n", F.explode(grams).alias("term")), vocab).groupBy("id", "term").agg(F.sum("n").alias("tf"))


def vocabulary(terms: DataFrame, cap: int, min_df: int = 1) -> DataFrame:
    """term, df: the cap most frequent terms (ties by term)."""
    counts = terms.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return counts.orderBy(F.desc("total"), "term").limit(cap).select("term", "df")


def word_vocabulary(df: DataFrame, text: Column, cap: int) -> DataFrame:
    """``vocabulary`` of ``word_terms``, for texts whose terms by document are more than what should be moved.

    Terms are counted without their documents, so tasks send each term once; documents are counted of the cap terms
    alone, inside their rows. Only ids that come in several rows are brought together.
    """
    rows = written(df.select("id", words_of(text).alias("w")))
    totals = rows.select(F.explode(words_and_pairs("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    kept = written(totals.orderBy(F.desc("total"), "term").limit(cap))
    repeated = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("again")))
    same = F.col("id").eqNullSafe(F.col("again"))
    once = rows.join(repeated, same, "left_anti").select(F.explode(F.array_distinct(words_and_pairs("w"))).alias("term"))
    several = rows.join(repeated, same, "left_semi").select("id", F.explode(F.array_distinct(words_and_pairs("w"))).alias("term"))
    found = _known(once, kept).unionByName(_known(several, kept).distinct().select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return kept.join(found, "term").orderBy(F.desc("total"), "term").select("term", "df")


def weighted(terms: DataFrame, vocab: DataFrame, n_docs: DataFrame, sublinear: bool = False) -> DataFrame:
    """id, term, w, df: TF-IDF with smooth idf, of unit length over the vocabulary's terms.

    n_docs: one row, n, the fitted documents.
    """
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = terms.join(vocab, "term").crossJoin(F.broadcast(n_docs)).withColumn("x", tf * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norms, "id").select("id", "term", (F.col("x") / F.col("norm")).alias("w"), "df")


class Index:
    """A TF-IDF index fitted on one side."""

    def __init__(self, df: DataFrame, text: Column, terms=char_terms, cap: int = CHARS_CAP, sublinear: bool = False):
        self.terms, self.sublinear = terms, sublinear
        own = written(terms(df, text))
        self.n_docs = df.agg(F.count(F.lit(1)).alias("n"))
        self.vocab = written(vocabulary(own, cap))
        self.vectors = weighted(own, self.vocab, self.n_docs, sublinear)

    def transform(self, df: DataFrame, text: Column) -> DataFrame:
        """Vectors of other rows; terms outside the vocabulary are dropped before they are counted, what is left is written once."""
        return weighted(written(self.terms(df, text, self.vocab)), self.vocab, self.n_docs, self.sublinear)


def prefixes(vectors: DataFrame, threshold: float) -> DataFrame:
    """The rarest terms of each vector, until what is left is shorter than threshold."""
    order = Window.partitionBy("id").orderBy("df", "term")
    before = F.coalesce(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return vectors.where("w > 0").withColumn("left", 1 - before).where(F.col("left") >= threshold * threshold - 1e-9).select("id", "term")


def cosine_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.0) -> DataFrame:
    """left_id, right_id, score (9 places) of pairs of cosine above 0, or of threshold and more."""
    a, b = left.select(F.col("id").alias("left_id"), "term", F.col("w").alias("a")), right.select(F.col("id").alias("right_id"), "term", F.col("w").alias("b"))
    if threshold > 0:
        pa, pb = prefixes(left, threshold).withColumnRenamed("id", "left_id"), prefixes(right, threshold).withColumnRenamed("id", "right_id")
        maybe = pa.join(pb, "term").select("left_id", "right_id").distinct()
        joined = maybe.join(a, "left_id").join(b, ["right_id", "term"])
    else:
        joined = a.join(b, "term")
    scores = joined.groupBy("left_id", "right_id").agg(F.round(F.sum(F.col("a") * F.col("b")), SCORE_PLACES).alias("score"))
    return scores.where(F.col("score") >= threshold if threshold > 0 else F.col("score") > 0)


#: Cosines at which ``best_pairs`` looks for matches before it takes any; blocks of a term's list.
LEVELS, BLOCKS = (0.75, 0.4), 8


def postings(vectors: DataFrame) -> DataFrame:
    """id, term, w, tail: the length of what a vector has from the term on, rarest terms first."""
    onward = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return vectors.where("w > 0").select("id", "term", "w", F.sqrt(F.sum(F.col("w") * F.col("w")).over(onward)).alias("tail"))


def blocked(lists: DataFrame) -> DataFrame:
    """lists with block: a term's list is cut by falling tails, so that block b has none above (b + 1) / BLOCKS."""
    return lists.withColumn("block", F.least(F.lit(BLOCKS - 1), F.floor(F.col("tail") * BLOCKS).cast("int")))


def candidates(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """left_id, right_id of pairs that may reach the query's floor.

    queries: postings with floor. At the first term that two vectors share, rarest first, their cosine is at most
    the product of their tails. Blocks whose highest tail is too low for a query are never joined with it.
    """
    low = F.floor((F.col("floor") - 1e-9) / F.col("tail") * BLOCKS).cast("int") - 1  # (b + 1) / BLOCKS * tail >= floor
    asked = queries.withColumn("block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: b >= low)))
    a, b = asked.alias("a"), lists.alias("b")
    met = (F.col("a.term") == F.col("b.term")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.tail") * F.col("b.tail") >= F.col("a.floor") - 1e-9)
    return a.join(b, met).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()


def best_pairs(left: DataFrame, right: DataFrame, k: int, levels=LEVELS) -> DataFrame:
    """left_id, right_id, score, rank: the k best of each left vector, cosine above 0.

    A query's floor is the level of the round or its k-th best score so far, whichever is higher. With k
    matches at or above its floor a query is settled; the others go on to the next level with what they have found.
    """
    queries, lists = written(postings(left)), written(blocked(postings(right)))
    weights = lists.select(F.col("id").alias("right_id"), "term", F.col("w").alias("b"))
    held = None
    todo = queries.select("id").distinct().withColumn("kth", F.lit(0.0))
    for level in (*levels, 0.0):
        asked = queries.join(todo.select("id", F.greatest("kth", F.lit(level)).alias("floor")), "id")
        met = candidates(asked, lists)
        if held is not None:
            met = met.join(held.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti")
        joined = met.join(queries.select(F.col("id").alias("left_id"), "term", F.col("w").alias("a")), "left_id").join(weights, ["right_id", "term"])
        scores = joined.groupBy("left_id", "right_id").agg(F.round(F.sum(F.col("a") * F.col("b")), SCORE_PLACES).alias("score")).where("score > 0")
        if held is not None:
            scores = scores.unionByName(held.select("left_id", "right_id", "score"))
        held = written(top_k(scores, k).select("left_id", "right_id", "score", "rank"))
        kth = held.where(F.col("rank") == k).select(F.col("left_id").alias("id"), F.col("score").alias("now"))
        todo = todo.join(kth, "id", "left").select("id", F.coalesce("now", F.lit(0.0)).alias("kth")).where(F.col("kth") < level)
        if level > 0:
            todo = written(todo)
    return held


def nearest(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, match, score of the best pair (ties: least match); null and 0 if there is none."""
    best = pairs.groupBy("left_id").agg(F.min_by(F.struct("right_id", "score"), F.struct((-F.col("score")).alias("s"), "right_id")).alias("b"))
    return ids.join(best, ids["id"] == best["left_id"], "left").select("id", F.col("b.right_id").alias("match"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def top_k(pairs: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy("left_id", *(by or [])).orderBy(F.desc("score"), "right_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_duplicates(train: DataFrame, test: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Test rows whose best training match reaches the threshold: id, match, score."""
    index = Index(train, F.col("body"), cap=WORDS_CAP)
    pairs = cosine_pairs(index.transform(test, F.col("body")), index.vectors, threshold)
    return nearest(pairs, test.select("id")).where("match is not null")


# Similarity from which a match is a tier.
IDENTICAL, PRECEDENT_FLOOR = 0.995, 0.85


def precedents(downgraded: DataFrame, approved: DataFrame, floor: float = PRECEDENT_FLOOR, k: int = 5) -> DataFrame:
    """id, match, score, rank: the first of the k nearest approved messages that keeps all placeholders."""
    index = Index(approved, F.col("body"))
    pairs = top_k(cosine_pairs(index.transform(downgraded, F.col("body")), index.vectors, floor), k)
    bodies = pairs.join(downgraded.select(F.col("id").alias("left_id"), F.col("body").alias("a")), "left_id").join(approved.select(F.col("id").alias("right_id"), F.col("body").alias("b")), "right_id")
    fit = bodies.where(F.size(F.array_except(placeholders(F.col("b")), placeholders(F.col("a")))) == 0)
    return fit.groupBy("left_id").agg(F.min_by(F.struct("right_id", "score", "rank", (normalized_content(F.col("a")) == normalized_content(F.col("b"))).alias("identical")), "rank").alias("m")).select(F.col("left_id").alias("id"), F.col("m.right_id").alias("match"), "m.score", "m.rank", "m.identical")


def retrieve(queries: DataFrame, corpus: DataFrame, approved: int = 2, downgraded: int = 1, floor: float = 0.2) -> DataFrame:
    """Nearest approved and downgraded messages; own id and identical body excluded."""
    index = Index(corpus, F.col("body"))
    pairs = cosine_pairs(index.transform(queries, F.col("body")), index.vectors, floor)
    side = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.col("body").alias(f"{name}_body"), *([F.col("cohort")] if name == "right" else []))
    rows = pairs.join(side(queries, "left"), "left_id").join(side(corpus, "right"), "right_id").where("left_id <> right_id AND left_body <> right_body")
    ranked = top_k(rows, max(approved, downgraded), ["cohort"])
    return ranked.where(F.col("rank") <= F.when(F.col("cohort") == "approved", approved).otherwise(downgraded)).select(F.col("left_id").alias("id"), "cohort", F.col("right_id").alias("match"), "score", "rank")


def agreement_by_similarity(pairs: DataFrame, labels: DataFrame, buckets=(0.95, 0.9, 0.8, 0.7)) -> DataFrame:
    """bucket (its lower end), pairs, share of pairs with equal labels."""
    low = F.coalesce(*[F.when(F.col("score") >= b, F.lit(b)) for b in buckets])
    rows = pairs.withColumn("bucket", low).where("bucket is not null")
    rows = rows.join(labels.select(F.col("id").alias("left_id"), F.col("label").alias("a")), "left_id").join(labels.select(F.col("id").alias("right_id"), F.col("label").alias("b")), "right_id")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 4).alias("agreement"))


def balanced_examples(pairs: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest of each label for each query, in ascending order of likeness: closest last."""
    rows = top_k(pairs.join(labels.select(F.col("id").alias("right_id"), "label"), "right_id"), k, ["label"])
    place = F.row_number().over(Window.partitionBy("left_id").orderBy("score", F.desc("right_id")))
    return rows.select(F.col("left_id").alias("id"), F.col("right_id").alias("match"), "label", "score", place.alias("place"))
