"""Spelling variants: words that differ by one character, and the frequent form that each stands for.

Near words are never paired.  A word of the vocabulary makes one key a position, (prefix,
suffix) around the replaced character; words of one key differ in just that place, so the
group keeps its size and its top two words, which give each member the number of its near
words there and the best one other than itself.  Words with one character deleted are joined with the
vocabulary for insertions and deletions.  What a word has from its groups is added up.

Counting reads every text once; all that follows works on the vocabulary.  A group holds at
most one word a letter of the alphabet, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import Scratch

RUNS = "[a-z\\u00C0-\\u00FF]+"
#: A run loses a character where this divides its checksum.
SLIP = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _without(word: Column, at: Column) -> Column:
    """``word`` less its character at ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def words(docs: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): words of ``shortest`` characters or more that occur ``least`` times or more.

    Runs of letters of whole texts, A-Z in lower case.  Where ``SLIP`` divides h, the CRC-32 of
    ``<doc_id>:<run>``, the run loses its character h mod length; a null doc_id counts as empty there.
    """
    lower = F.translate(F.col("text"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUNS), F.lit(0))).alias("run"))
    # A run one shorter than the least may not grow, so it can't become a word.
    long = runs.filter(F.length("run") >= shortest).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    slipped = F.when(F.col("h") % SLIP == 0, _without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return long.select(slipped.alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") >= shortest) & (F.col("n") >= least))


def _best(n: Column, word: Column) -> Column:
    """Smallest where n is largest, then where the word is smallest."""
    return F.struct((-n).alias("minus"), word.alias("word"))


def _replaced(vocabulary: DataFrame) -> DataFrame:
    """(word, near, best) from each wildcard group that a word shares with others."""
    place = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    keyed = vocabulary.select("word", "n", place.alias("at"))
    keyed = keyed.select("word", "n", F.concat(F.substring("word", F.lit(1), F.col("at")), F.lit("*"), F.substring(F.col("word"), F.col("at") + 2, F.length("word"))).alias("key"))
    group = Window.partitionBy("key")
    first_two = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = _best(F.col("n"), F.col("word"))
    sized = keyed.withColumns({"size": F.count("*").over(group), "one": F.nth_value(top, 1).over(first_two), "two": F.nth_value(top, 2).over(first_two)}).filter("size > 1")
    return sized.select("word", (F.col("size") - 1).alias("near"), F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one")).alias("best"))


def _indels(vocabulary: DataFrame) -> DataFrame:
    """(word, near, best) from deletions that are words: for the longer word the shorter one, for the shorter one the longer."""
    deleted = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda at: _without(F.col("word"), at))))
    cut = vocabulary.select(F.col("word").alias("longer"), F.col("n").alias("longer_n"), deleted.alias("shorter"))
    met = cut.join(vocabulary, cut["shorter"] == vocabulary["word"]).select("longer", "longer_n", "shorter", F.col("n").alias("shorter_n"))
    sides = F.explode(F.array(F.struct(F.col("longer").alias("word"), _best(F.col("shorter_n"), F.col("shorter")).alias("best")), F.struct(F.col("shorter").alias("word"), _best(F.col("longer_n"), F.col("longer")).alias("best"))))
    return met.select(sides.alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.best")


def forms(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n) of a table (word, n) of distinct words."""
    near = _replaced(vocabulary).unionByName(_indels(vocabulary)).groupBy(F.col("word").alias("__w")).agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    joined = vocabulary.join(near, F.col("word") == F.col("__w"), "left")
    best_n = -F.col("best.minus")
    far = best_n >= times * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.word")).alias("form"), F.when(far, best_n).alias("form_n"))


def ends(found: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(word, root) of each word of ``forms`` that has a form, by doubling the steps; each round is written."""
    scratch = scratch or Scratch(found.sparkSession)
    steps = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("__from"), F.col("root").alias("__to"))
        after = scratch.write(steps.join(onward, F.col("root") == F.col("__from"), "left").select("word", F.coalesce("__to", "root").alias("root"), F.col("__to").isNotNull().alias("moved")), "roots")
        steps = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return steps


def group(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word, its form and where the forms end.

    Words as in ``words``.  Two are near if they differ by exactly one inserted, deleted or replaced
    character; ``n_near`` is their number.  The form is the near word of largest n, of equal
    ones the smallest in code-point order, if that n is at least ``times`` the word's own.  A
    form's n is larger each time, so chains end; ``root`` is the last word of the chain, found
    by doubling the steps, in as many joins as the logarithm of the longest chain.

    Null texts have no words, repeated rows count each; other columns than doc_id and text,
    whatever their names, are not read.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    vocabulary = scratch.write(words(docs, shortest, least), "words")
    found = scratch.write(forms(vocabulary, times), "forms")
    last = ends(found, scratch).select(F.col("word").alias("__w"), "root")
    return found.join(last, F.col("word") == F.col("__w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_sql(shortest: int = 6, least: int = 5, times: int = 5) -> str:
    """The same in DuckDB's SQL over ``documents``: pairs by shared wildcards and deletions, and the checksum bit by bit."""
    table = "list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    octets = "list_transform(range(length(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)"
    return f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT {table} AS t),
    runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
    counted AS (SELECT run, m, hex(encode(id || ':' || run)) AS x FROM (SELECT id, run, count(*) AS m FROM runs WHERE length(run) >= {shortest} GROUP BY ALL)),
    summed AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM counted, tab),
    slipped AS (SELECT m, CASE WHEN h % {SLIP} = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM summed),
    words AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM slipped WHERE length(word) >= {shortest} GROUP BY word HAVING sum(m) >= {least}),
    places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
    wild AS (SELECT word, n, left(word, CAST(i AS INTEGER)) || '*' || substr(word, CAST(i AS INTEGER) + 2) AS k FROM places),
    gone AS (SELECT DISTINCT word, n, left(word, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS k FROM places),
    near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM wild a JOIN wild b ON a.k = b.k AND a.word <> b.word
        UNION ALL SELECT g.word, g.n, w.word, w.n FROM gone g JOIN words w ON g.k = w.word UNION ALL SELECT w.word, w.n, g.word, g.n FROM gone g JOIN words w ON g.k = w.word),
    best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS nth FROM near),
    forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN other_n >= {times} * w.n THEN other END AS form, CASE WHEN other_n >= {times} * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND nth = 1),
    chain AS (SELECT word, word AS node, 0 AS depth FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.node WHERE f.form IS NOT NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, max_by(node, depth) AS root FROM chain GROUP BY word) r ON r.word = f.word"""
