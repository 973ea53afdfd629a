"""Spelling variants: words one edit apart, found by walking a trie relation level by level (operator 13).

Words are counted by Spark. Of two words that differ by one edit, either the first half of the longer
one is untouched or the second half is. So there are two tries, one over words and one over reversed
words, and in both only edits behind a word's middle are tried: near the roots, where all words pass, nothing
fans out. Both are one path-compressed edge table (node, first character) -> (child, label, word that ends there).

A state is (word, position, node, edits). States without an edit are a word's own stops: the nodes on its
path where paths part or words end. There the states with one edit begin, by another edge than the word's
own: the word's character is replaced, or left out. Each round joins the states with the edge table and keeps
those whose label is the word's next characters; a state whose word is used up at a node where a word ends is
a pair. Inserted characters are the same pairs seen from the shorter word. Nodes are named by 64-bit hashes
of their prefixes; a shared name could only add pairs, and every pair is checked by its edit distance.

A node has at most as many edges as characters exist, so states grow with the words. Nodes on the path of
many words are dealt by (node, salt), their few edges repeated. A word costs memory by its length only.

Defined results: null text has no words; a null id is written as an empty string in the hash; repeated rows
count each; other columns are ignored; empty tables give no rows. Words of any length are compared.
Equal counts are decided by code-point order. Forms lead to words at least ten times as frequent, so
chains of forms end, and `root` follows them by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Runs of letters. Fixed by the contract, as are the next four.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARACTERS = 7
LEAST_COUNT = 2
DELETED_OF = 31
FORM_FACTOR = 10
#: Words of a node that are dealt to one salt.
WORDS_A_SALT = 20_000
#: Two odd multipliers and two starts of the prefix hashes. Any will do.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
STARTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)
END = -1


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: the runs of all texts, some with a character deleted, that are long and frequent enough."""
    run = common.lower_ascii(F.col("run"))
    runs = docs.select(F.col("doc_id").cast("string").alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_CHARACTERS},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc", run.alias("run")).withColumn("h", F.crc32(F.concat(F.coalesce("doc", F.lit("")), F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETED_OF == 0, shorter).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).filter(F.length("word") >= LEAST_CHARACTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def prefix_nodes(words: list[str], reverse: bool):
    """(row, depth, node, next character or END) of each prefix that holds the untouched half, as numpy arrays."""
    words = [w[::-1] for w in words] if reverse else words
    sizes = np.array([len(w) for w in words])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    begins = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1][order]
    least = sizes - sizes // 2 if reverse else sizes // 2
    nodes = np.full(len(words), STARTS[int(reverse)], np.uint64)
    found = []
    for depth in range(int(sizes[0]) + 1 if len(sizes) else 0):
        live = np.searchsorted(-sizes, -depth, side="right")  # words of at least `depth` characters
        going = np.searchsorted(-sizes, -depth, side="left")  # words of more
        after = np.full(live, END, np.int64)
        after[:going] = codes[begins[:going] + depth]
        kept = np.flatnonzero(least[:live] <= depth)
        found.append((order[kept], np.full(len(kept), depth), nodes[kept], after[kept]))
        mixed = (nodes[:going] ^ after[:going].astype(np.uint64)) * MULTIPLIERS[0]
        nodes[:going] = (mixed ^ mixed >> np.uint64(29)) * MULTIPLIERS[1]
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4


def prefixes(words: DataFrame) -> DataFrame:
    """id, back, depth, node, after: a row per word, direction and prefix that holds the untouched half."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for back in (False, True):
                row, depth, node, after = prefix_nodes(texts, back)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array([back] * len(row), pa.bool_()), pa.array(depth.astype(np.int32)), pa.array(node.astype(np.uint64).view(np.int64)), pa.array(after.astype(np.int32))],
                    ["id", "back", "depth", "node", "after"],
                )

    return common.by_batches(words.select("id", "word"), run, "id long, back boolean, depth int, node long, after int")


def stops(words: DataFrame) -> DataFrame:
    """A word's own states: nodes on its path where paths part, and its end; `way` is the word as it is read there.

    `among` is how many words pass the node, null at an end where nothing parts.
    """
    every = prefixes(words)
    forks = every.groupBy("node").agg(F.min("after").alias("least"), F.max("after").alias("most"), F.count("*").alias("among")).filter("least < most")
    found = every.join(forks.select("node", "among"), "node", "left").filter(F.col("among").isNotNull() | (F.col("after") == END))
    # Reading on from a stop, the word comes to its next one.
    path = Window.partitionBy("id", "back").orderBy("depth")
    ahead = F.lead(F.struct("node", "depth", "after")).over(path)
    found = found.repartition("id").withColumn("ahead", ahead).filter(F.col("among").isNotNull())
    way = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    return found.join(words, "id").select("id", "n", "back", "depth", "node", "after", "among", "ahead", way.alias("way"))


def characters(text, start, length):
    """`length` characters from the zero-based `start`."""
    return F.substring(text, start + 1, length)


def edges(own: DataFrame) -> DataFrame:
    """node, first (character, or END for a word that ends at the node), child, label, ends (word that ends at the child), among."""
    ending = F.col("after") == END
    label = characters(F.col("way"), F.col("depth"), F.col("ahead.depth") - F.col("depth"))
    ends = F.when(ending | (F.col("ahead.after") == END), F.col("id"))
    rows = own.select("node", F.col("after").alias("first"), "among", F.when(ending, F.col("node")).otherwise(F.col("ahead.node")).alias("child"), F.when(ending, F.lit("")).otherwise(label).alias("label"), ends.alias("ends"))
    return rows.groupBy("node", "first").agg(F.max("child").alias("child"), F.max("label").alias("label"), F.max("ends").alias("ends"), F.max("among").alias("among"))


def moved(joined: DataFrame, reached) -> DataFrame:
    """States behind an edge; `reached` is an array of positions in the word, null where the label doesn't fit."""
    return joined.select("id", "n", "back", "way", "node_to", "ends", F.explode(F.array_compact(reached)).alias("at")).filter(F.col("at") <= F.length("way"))


def finished(states: DataFrame) -> DataFrame:
    return states.filter((F.col("at") == F.length("way")) & F.col("ends").isNotNull()).select("id", "n", "back", "way", F.col("ends").alias("other"))


def going_on(states: DataFrame) -> DataFrame:
    return states.filter(F.col("at") < F.length("way")).select("id", "n", "back", "way", "at", F.col("node_to").alias("node"), F.ascii(characters(F.col("way"), F.col("at"), F.lit(1))).alias("first"))


def neighbours(words: DataFrame, write) -> DataFrame:
    """id, other, other_n, other_word: every pair of words (id, word, n) one edit apart, from both sides, perhaps repeated."""
    own = write(stops(words))
    trie = write(edges(own))
    salts = lambda c: F.ceil(F.col(c) / WORDS_A_SALT).cast("int")
    salted = trie.withColumn("salt", F.explode(F.sequence(F.lit(0), salts("among") - 1))).select("node", "salt", F.col("first").alias("first_to"), F.col("child").alias("node_to"), "label", "ends")
    begun = own.filter(F.col("after") != END).withColumn("salt", F.pmod(F.hash("id"), salts("among"))).drop("ahead", "among")
    joined = begun.join(salted, ["node", "salt"]).filter(F.col("first_to") != F.col("after"))
    size, way, depth = F.length("label"), F.col("way"), F.col("depth")
    replaced = F.when((F.col("first_to") != END) & (characters(way, depth + 1, size - 1) == characters(F.col("label"), F.lit(1), size - 1)), depth + size)
    left_out = F.when(characters(way, depth + 1, size) == F.col("label"), depth + 1 + size)
    # A word that ends at the node is one that lacks the last character.
    left_out = F.when((F.col("first_to") != END) | (depth + 1 == F.length(way)), left_out)
    states = write(moved(joined, F.array(replaced, left_out)))
    pairs = [finished(states)]
    plain = trie.filter(F.col("first") != END).select("node", "first", F.col("child").alias("node_to"), "label", "ends")
    # A label has at least one character: no more rounds than the longest word has characters.
    while not (open_states := going_on(states)).isEmpty():
        fits = F.when(characters(way, F.col("at"), size) == F.col("label"), F.col("at") + size)
        states = write(moved(open_states.join(plain, ["node", "first"]), F.array(fits)))
        pairs.append(finished(states))
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    met = found.join(words.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n")), "other")
    word = F.when(F.col("back"), F.reverse("way")).otherwise(F.col("way"))
    met = met.withColumn("word", word).filter(F.levenshtein("word", "other_word", 1) == 1)
    return met.select(
        F.explode(F.array(F.struct("id", "other", "other_n", "other_word"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("word").alias("other_word")))).alias("pair")
    ).select("pair.*")


def roots(forms: DataFrame, write) -> DataFrame:
    """id, root of (id, root): every pointer follows the one it leads to until none leads on; half the way a round."""
    while True:
        on = forms.select(F.col("id").alias("root"), F.col("root").alias("further"))
        joined = write(forms.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forms = joined.select("id", "root")
        if joined.filter("moved").isEmpty():
            return forms


def spellings(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of the documents' texts."""
    spark = docs.sparkSession
    with common.scratch(spark) as write:
        # The ids are those of the written rows; they name words in joins, whatever the words' length.
        words = write(count_words(docs).select(F.monotonically_increasing_id().alias("id"), "word", "n"))
        pairs = neighbours(words, write).repartition("id").dropDuplicates(["id", "other"])
        best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other_word").alias("form"), "other"))
        near = pairs.groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"))
        formed = F.col("best.less") * -1 >= F.col("n") * FORM_FACTOR
        rows = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(formed, F.col(f"best.{a}")).alias(b) for a, b in (("form", "form"), ("less", "less"), ("other", "form_id"))])
        rows = write(rows)
        ends = roots(write(rows.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("root"))), write)
        named = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
        out = rows.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", (-F.col("less")).alias("form_n"))
        return common.written(out)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings(common.read(spark, sf_dir, "documents"))


#: CRC-32 by its table of 256 entries, made here bit by bit; the polynomial is the usual one, reversed.
ORACLE_SQL = {
    "op13_spelling": """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
coded AS (
  SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bytes FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS h FROM coded, crc_table),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, i, word[: i - 1] AS head, word[i + 1 :] AS tail FROM words, unnest(range(1, length(word) + 1)) u(i)),
shorter AS (SELECT DISTINCT h.word AS a, w.word AS b FROM holes h JOIN words w ON w.word = h.head || h.tail),
near AS (
  SELECT DISTINCT x.word AS a, y.word AS b FROM holes x JOIN holes y ON x.head = y.head AND x.tail = y.tail AND x.word <> y.word
  UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
best AS (
  SELECT a, b, w.n AS form_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, encode(b)) AS place
  FROM near JOIN words w ON w.word = b),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * w.n THEN b END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best ON w.word = a AND place = 1),
walk(word, reached, further) AS (
  SELECT word, word, form FROM formed
  UNION ALL SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON formed.word = walk.further)
SELECT formed.word, form, walk.reached AS root, n, n_near, form_n FROM formed JOIN walk ON walk.word = formed.word AND walk.further IS NULL
""",
}
