"""Spelling variants: words one edit apart, found by scanning sorted lists.

Vocabulary. Words are runs of letters of whole texts, lower-cased in A-Z and
counted over all documents (the contract's planted slips included); rare and
short ones are left out.

Blocks. Two words of which the shorter has ``l`` code points differ by one
edit only if they share their first ``l // 2`` or their last ``l - l // 2``
code points. So every word joins the lists of its own length and of the length
below, once by its head and once by its tail. A list of more than ``BLOCK``
words is split again by the same argument on what its words don't share, until
at most one code point is open: such a list is bounded by the alphabet. A pair
counts only in the list that the place of its first difference leads to, so no
pair is found twice.

Scan. The words of a list are sorted (by their reversed text where they share
a tail). For every word, rows of the edit matrix, a band of three cells capped
at two, are carried along the list: the longest common prefix of neighbours
tells which rows stay, so a row is computed once for all words that share a
prefix, and a run of words whose shared prefix is already more than one edit
away is skipped as a whole. One step takes all words and runs of a few
thousand sorted rows one code point further.

Empty tables, null texts and texts without letters yield nothing; a null id
counts as the empty text in the slip rule; repeated rows are counted one by
one; words of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.scratch import materialize

LETTERS = "[A-Za-zÀ-ÿ]+"
SLIP = 97
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
BLOCK = 16_384  # words of a list that one task holds at once

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of all texts; ``slip``: a run whose crc32 with its id it divides loses one code point (0: none does)."""
    run = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("run"))
    run = run.where(F.length("run") >= min_length).withColumn("run", F.translate("run", _UPPER, _LOWER))
    word: Column = F.col("run")
    if slip:
        crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (crc % F.length("run")).cast("int")
        word = F.when(crc % slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
                      ).otherwise(word)
    return run.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= min_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the two lists that halve its open part: ``head`` or ``tail`` code points more are shared."""
    half = F.expr("(size - head - tail) div 2").cast("int")
    rest = F.col("size") - F.col("head") - F.col("tail") - half
    both = F.explode(F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
                             F.struct(F.col("head").alias("head"), (F.col("tail") + rest).alias("tail"))))
    keyed = rows.select("word", "n", "size", both.alias("_p")).select("word", "n", "size", "_p.head", "_p.tail")
    return keyed.withColumn("key", F.concat_ws(
        "\t", "size", "head", "tail", F.substring("word", F.lit(1), F.col("head")), F.right("word", F.col("tail"))))


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, size, head, tail, word, n): the sorted lists' rows; ``size`` is the shorter word's length."""
    length = F.length("word")
    rows = _halves(words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size")).where("size > 0")
                   .withColumns({"head": F.lit(0), "tail": F.lit(0)}))
    done = None
    while True:
        large = rows.where("size - head - tail > 1").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > block).select("key")
        large = materialize(large, "lists")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        # halving goes on for the rows of large lists only
        rows = materialize(_halves(rows.join(large, "key", "left_semi").drop("key")), "open")


def adjacent_prefixes(codes: np.ndarray, start: np.ndarray, length: np.ndarray, shared: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Common prefix of every word with the one before, less what its whole list shares; -1 at a list's first."""
    lcp = np.full(len(start), -1, np.int64)
    live = np.flatnonzero(~first)
    lcp[live] = 0
    while len(live):
        at = shared[live] + lcp[live]
        inside = (at < length[live]) & (at < length[live - 1])
        live, at = live[inside], at[inside]
        same = codes[start[live] + at] == codes[start[live - 1] + at]
        live = live[same]
        lcp[live] += 1
    return lcp


def near_pairs(codes: np.ndarray, start: np.ndarray, length: np.ndarray, shared: np.ndarray, first: np.ndarray,
               lcp: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, other): rows of one list at edit distance one, for the rows ``queries`` of sorted lists.

    ``codes`` holds the words' code points from ``start`` on, ``shared`` the
    number that the words of a row's list have in common at the front, ``lcp``
    what ``adjacent_prefixes`` gives.
    """
    begin = np.flatnonzero(first)
    which = np.searchsorted(begin, queries, "right") - 1
    end = np.append(begin[1:], len(start))
    q, lo, hi = queries, begin[which], end[which]
    busy = hi - lo > 1
    q, lo, hi = q[busy], lo[busy], hi[busy]
    # cells of the current row under the query's code points depth - 1, depth and depth + 1
    left, mid = np.ones(len(q), np.int8), np.zeros(len(q), np.int8)
    right = np.ones(len(q), np.int8)
    left[shared[q] == 0] = 2
    right[shared[q] + 1 > length[q]] = 2
    found_q, found_w = [], []
    step = 0
    while len(q):
        # the runs that agree in one more code point: they start where the common prefix ends here
        runs = np.flatnonzero(lcp <= step)
        a, b = np.searchsorted(runs, lo), np.searchsorted(runs, hi)
        count = b - a
        own = np.repeat(np.arange(len(q)), count)
        place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + a[own]
        bounds = np.append(runs, len(start))
        q, lo, hi = q[own], bounds[place], np.minimum(bounds[place + 1], hi[own])
        left, mid, right = left[own], mid[own], right[own]
        depth = shared[q] + step
        over = length[q] - depth  # the query's code points beyond this row's middle cell
        ends = length[lo] == depth
        if ends.any():  # a word that ends here is the first of its run, alone in it
            e = np.flatnonzero(ends)
            cell = np.where(over[e] == 0, mid[e], np.where(over[e] == 1, right[e], np.where(over[e] == -1, left[e], 2)))
            hit = e[cell == 1]
            found_q.append(q[hit])
            found_w.append(lo[hit])
        go = ~ends & ~((hi - lo == 1) & (lo == q))
        q, lo, hi, left, mid, right, depth, over = (x[go] for x in (q, lo, hi, left, mid, right, depth, over))
        if not len(q):
            break
        own_at = start[q] + depth
        last = len(codes) - 1
        char = codes[start[lo] + depth]
        differs0 = (codes[np.clip(own_at - 1, 0, last)] != char).astype(np.int8)
        differs1 = (codes[np.minimum(own_at, last)] != char).astype(np.int8)
        differs2 = (codes[np.minimum(own_at + 1, last)] != char).astype(np.int8)
        # next row: cells under code points depth, depth + 1, depth + 2; cells past the query's end count two
        new0 = np.minimum(np.where((depth > 0) & (over > -1), left + differs0, 2), mid + 1)
        new0 = np.where(over >= 0, new0, 2)
        new1 = np.where(over >= 1, np.minimum(np.minimum(mid + differs1, right + 1), new0 + 1), 2)
        new2 = np.where(over >= 2, np.minimum(right + differs2, new1 + 1), 2)
        alive = (new0 <= 1) | (new1 <= 1) | (new2 <= 1)
        q, lo, hi = q[alive], lo[alive], hi[alive]
        left, mid, right = (np.minimum(x[alive], 2).astype(np.int8) for x in (new0, new1, new2))
        step += 1
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_w)


_PAIR = "word string, near string, near_n long"
_QUERIES = 4096  # rows whose matrix rows are carried at once


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of lists that arrive sorted by key and text; whole lists only, a few thousand rows at a time."""
    for table in _whole_lists(batches):
        key = table.column("key").to_numpy(zero_copy_only=False)
        text = table.column("text").to_pylist()
        size, head, tail, n = (table.column(c).to_numpy().astype(np.int64) for c in ("size", "head", "tail", "n"))
        first = np.append(True, key[1:] != key[:-1])
        length = np.fromiter(map(len, text), np.int64, len(text))
        start = np.cumsum(length) - length
        codes = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        shared = np.maximum(head, tail)
        lcp = adjacent_prefixes(codes, start, length, shared, first)
        queries = np.flatnonzero(length == size)
        for at in range(0, len(queries), _QUERIES):
            a, b = near_pairs(codes, start, length, shared, first, lcp, queries[at:at + _QUERIES])
            rows = []
            for i, j in zip(a.tolist(), b.tolist()):
                s, w = (text[i][::-1], text[j][::-1]) if tail[i] > head[i] else (text[i], text[j])
                if tail[i] and s[:(cut := size[i] - tail[i])] == w[:cut]:
                    continue  # first difference in the shared tail: the pair belongs to another list
                rows.append((s, w, n[j]))
                if length[j] > length[i]:
                    rows.append((w, s, n[i]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows again, cut between lists, ``BLOCK`` rows or one list at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < BLOCK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column("key").to_numpy(zero_copy_only=False)
        cut = int(np.argmax(key == key[-1]))
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), len(table) - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every ordered pair of words of ``words`` (word, n) that are one edit apart."""
    rows = blocks(words, block)
    text = F.when(F.col("tail") > F.col("head"), F.reverse("word")).otherwise(F.col("word"))
    lists = rows.select("key", text.alias("text"), "size", "head", "tail", "n")
    spread = lists.repartition("key").sortWithinPartitions("key", "text")
    return spread.mapInArrow(_scan, _PAIR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form), by doubling the steps in every round.

    A form is at least ``RATIO`` times as frequent as its word, so chains are
    short (the logarithm of the largest count) and have no cycles.
    """
    ahead = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(ahead.join(step, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        ahead = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return ahead


def variant_groups(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; one row per word)."""
    words = materialize(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    fits = -F.col("_best.less") >= F.col("n") * ratio
    joined = materialize(words.join(near, "word", "left").select(
        "word", F.when(fits, F.col("_best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("_best.less")).alias("form_n")), "variants")
    ends = roots(joined.where(F.col("form").isNotNull()).select("word", "form"))
    return joined.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of documents: word, form, root, n, n_near, form_n."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variant_groups(vocabulary(docs.select("doc_id", "text")))


# crc32 is linear: a byte's share is its table value carried through the bytes after it
OP11_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT DISTINCT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY 1, 2),
keyed AS (SELECT row_number() OVER () AS rid, run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs),
bits AS (
  SELECT i AS b, 0 AS k, i::UBIGINT AS v FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) FROM bits WHERE k < 8),
tab AS (SELECT b, v AS t FROM bits WHERE k = 8),
most AS (SELECT max(length(hx) // 2) AS m FROM keyed),
carried AS (
  SELECT b, 1 AS k, t AS v FROM tab
  UNION ALL SELECT c.b, c.k + 1, xor(c.v >> 8, t.t) FROM carried c JOIN tab t ON t.b = (c.v & 255) WHERE c.k < (SELECT m FROM most)),
fresh AS (
  SELECT 0 AS k, 4294967295::UBIGINT AS v
  UNION ALL SELECT f.k + 1, xor(f.v >> 8, t.t) FROM fresh f JOIN tab t ON t.b = (f.v & 255) WHERE f.k < (SELECT m FROM most)),
bytes AS (
  SELECT rid, length(hx) // 2 - i AS k, ('0x' || substr(hx, 2 * i + 1, 2))::INT AS b
  FROM (SELECT rid, hx, unnest(range(length(hx) // 2)) AS i FROM keyed)),
crc AS (SELECT rid, bit_xor(c.v) AS v FROM bytes JOIN carried c USING (b, k) GROUP BY rid),
hashed AS (
  SELECT run, c, xor(xor(crc.v, f.v), 4294967295::UBIGINT) AS h FROM keyed JOIN crc USING (rid) JOIN fresh f ON f.k = length(hx) // 2),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c
  FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
holes AS (
  SELECT word, n, length(word) AS len, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.len = b.len AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
joined AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form,
         CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r USING (word)),
walk AS (
  SELECT word, word AS at FROM joined
  UNION ALL SELECT k.word, j.form FROM walk k JOIN joined j ON j.word = k.at WHERE j.form IS NOT NULL),
ends AS (SELECT k.word, k.at AS root FROM walk k JOIN joined j ON j.word = k.at WHERE j.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM joined JOIN ends USING (word)
"""
