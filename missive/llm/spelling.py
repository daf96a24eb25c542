"""Spelling variants by asymmetric q-chunks (Qin et al. 2011).

Two words are near if one code point inserted, deleted or replaced turns one into the other.
The shorter word of a pair (of equal ones the lesser) is cut into two disjoint chunks, its
first floor(length / 2) code points and the rest. One edit spoils at most one of the two, so
the other word has the other chunk among its positional grams, moved by at most one place.
Chunks and grams meet by the shorter word's length, the chunk's place and its characters;
grams more than one place away from a chunk's place can meet none and are left out before the
join. Pairs that meet are verified by their edit distance inside the join, so only near pairs
leave it; a pair that meets at both chunks counts at the first. Chunks of more than CAP words
or grams are dealt out in both directions, so that no task sees more than CAP of each.

Words have at most some hundreds of near words for each of their letters, whatever the corpus,
but any number of words may end at one root: roots are found by pointers that double their
reach, with joins that spread hot roots. No table with a row for a word or more is broadcast: files
are far smaller than their rows in memory, and Spark sizes exploded rows by the file they come from.

Defined results: a null or empty text has no words; the doc_id of a null id is ``null`` in the
hash; rows of repeated ids or texts count each time; an empty table gives no words; other
columns are ignored; words of any length are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.buckets import BROADCAST_BUCKETS, spread_join
from missive.llm.common import discard, prepare, table, text_or_empty, written

# What a word is, and which runs lose a code point.
RUN, UPPER, LOWER, ONE_IN = "[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", 97
# End of fixed values.
MIN_CHARS, MIN_COUNT, FACTOR = 5, 3, 2
CAP = 2000
KEY = ("of", "at", "piece")


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """docs (doc_id, text) -> word, n: words of so many code points, with misspellings planted by a hash, and their occurrences."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_or_empty(), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_chars).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run"))
    runs = runs.select("run", F.crc32(F.encode(named, "UTF-8")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    spoilt = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % ONE_IN == 0, spoilt).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def chunk(word: Column, length: Column, at: Column) -> Column:
    """The chunk that begins at ``at``, which is 0 or half the length."""
    return F.substring(word, at + 1, F.when(at == 0, half(length)).otherwise(length - half(length)))


def chunks(words: DataFrame) -> DataFrame:
    """word, n, and the keys of its two disjoint chunks."""
    size = F.length("word")
    rows = words.withColumns({"of": size, "at": F.explode(F.array(F.lit(0), half(size)))})
    return rows.select("word", "n", "of", "at", chunk(F.col("word"), F.col("of"), F.col("at")).alias("piece"))


def grams(words: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """word, n, and the keys of its positional grams for partners of its own length or one less, within a shift of one."""
    rows = words.withColumn("size", F.length("word"))
    rows = rows.withColumn("of", F.explode(F.filter(F.array(F.col("size"), F.col("size") - 1), lambda x: x >= min_chars)))
    rows = rows.withColumn("at", F.explode(F.array(F.lit(0), half(F.col("of")))))
    width = F.when(F.col("at") == 0, half(F.col("of"))).otherwise(F.col("of") - half(F.col("of")))
    near = F.sequence(F.greatest(F.lit(0), F.col("at") - 1), F.least(F.col("at") + 1, F.col("size") - width))
    pieces = F.array_distinct(F.transform(near, lambda p: F.substring(F.col("word"), p + 1, width)))
    return rows.select("word", "n", "of", "at", F.explode(pieces).alias("piece"))


def _dealt(left: DataFrame, right: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with part: a key of more than cap rows on a side is g x h parts, of which each row of a side is in one row or column."""
    sides = left.select(*KEY, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*KEY, F.lit(0).alias("l"), F.lit(1).alias("r")))
    hot = sides.groupBy(*KEY).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where(((F.col("l") > cap) & (F.col("r") > 0)) | ((F.col("r") > cap) & (F.col("l") > 0)))
    hot = written(hot.select(*KEY, F.ceil(F.col("l") / cap).cast("int").alias("g"), F.ceil(F.col("r") / cap).cast("int").alias("h")), "hot-chunks", n=F.count(F.lit(1)))
    few = hot.metrics["n"] <= BROADCAST_BUCKETS
    out = []
    for rows, own, other in ((left, "g", "h"), (right, "h", "g")):
        rows = rows.join(F.broadcast(hot) if few else hot, list(KEY), "left").na.fill(1, ["g", "h"])
        mine = F.pmod(F.xxhash64("word"), F.col(own)).cast("int")
        part = (lambda x: mine * F.col("h") + x) if own == "g" else (lambda x: x * F.col("h") + mine)
        parts = F.transform(F.sequence(F.lit(0), F.col(other) - 1), part)
        out.append(rows.select("word", "n", *KEY, F.explode(parts).alias("part")))
    return out[0], out[1]


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, cap: int = CAP) -> DataFrame:
    """words (word, n) of at least min_chars code points -> word, n, other, other_n: each near pair once, word the shorter or lesser."""
    left, right = _dealt(chunks(words), grams(words, min_chars), cap)
    a, b = left.alias("a"), right.alias("b")
    met = F.lit(True)
    for k in (*KEY, "part"):
        met = met & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    first = chunk(F.col("a.word"), F.col("a.of"), F.lit(0))
    earlier = (F.substring(F.col("b.word"), F.lit(1), half(F.col("a.of"))) == first) | (F.substring(F.col("b.word"), F.lit(2), half(F.col("a.of"))) == first)
    # one edit in the other half leaves one of its ends as it is: far cheaper to see than the distance
    q, shift = half(F.col("a.of")), F.length("b.word") - F.col("a.of")
    same = lambda i, j: F.substring("a.word", i, F.lit(1)) == F.substring("b.word", j, F.lit(1))
    ends = F.when(F.col("a.at") == 0, same(F.lit(-1), F.lit(-1)) | same(q + 1, q + 1)).otherwise(same(F.lit(1), F.lit(1)) | same(q, q + shift))
    ordered = (F.length("a.word") < F.length("b.word")) | (F.col("a.word") < F.col("b.word"))
    verified = ordered & ends & ((F.col("a.at") == 0) | ~earlier) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    return a.join(b.hint("merge"), met & verified).select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> word, root, by pointers that double their reach; a form has more occurrences than its word, so none leads back."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "word-roots", moved=F.count(F.lit(1)))
    while now.metrics["moved"]:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = spread_join(now.select("word", "root"), ahead, "root", "word", "left")
        done, now = now, written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots", moved=F.count_if("moved"))
        discard(done)
    return now.select("word", "root")


def spelling_groups(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR, cap: int = CAP) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n.

    A word's form is its near word of most occurrences (of equals the least in code-point order), if those are
    at least factor times the word's.
    """
    prepare(docs.sparkSession)
    words = written(vocabulary(docs, min_chars, min_count), "vocabulary")
    pairs = written(near_words(words, min_chars, cap), "near-words")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("form")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = words.join(near.hint("merge"), "word", "left")
    taken = -F.col("best.k") >= factor * F.col("n")
    known = known.select("word", F.when(taken, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.k")).alias("form_n"))
    known = written(known, "word-forms")
    ends = roots(known.where("form is not null").select("word", "form"))
    return known.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE crc_table AS MATERIALIZED (
    SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
    FROM range(256) AS r(i)
),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
),
lowered AS MATERIALIZED (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM runs WHERE length(run) >= 5 GROUP BY ALL
),
hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h
    FROM lowered, crc_table
),
words AS MATERIALIZED (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
),
stems AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS stem FROM words, unnest(range(1, length(word) + 1)) AS u(i)
),
pairs AS (
    SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM stems a JOIN stems b ON a.i = b.i AND a.stem = b.stem AND a.word <> b.word
    UNION
    SELECT DISTINCT a.word, a.n, b.word, b.n FROM stems a JOIN words b ON a.stem = b.word
    UNION
    SELECT DISTINCT b.word, b.n, a.word, a.n FROM stems a JOIN words b ON a.stem = b.word
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
),
known AS MATERIALIZED (
    SELECT w.word, CASE WHEN other_n >= 2 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN ranked r ON w.word = r.word AND k = 1
),
chain AS (
    SELECT word, word AS root FROM known
    UNION ALL
    SELECT c.word, k.form FROM chain c JOIN known k ON c.root = k.word WHERE k.form IS NOT NULL
)
SELECT k.word, k.form, c.root, k.n, k.n_near, k.form_n
FROM known k JOIN chain c ON c.word = k.word JOIN known e ON e.word = c.root AND e.form IS NULL
"""
