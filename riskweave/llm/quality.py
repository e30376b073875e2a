"""Quality by weak labels: overlapping heuristics, their accuracies by expectation-maximisation, a hashed scorer.

Heuristics look at plain counts of a text. Each casts one kind of vote or is
silent: eight find signs of junk (bad, -1), three find signs of prose (good,
1), and they overlap. How far a vote can be trusted isn't given: in the label
model, whether a heuristic votes says nothing, and a vote is right with the
heuristic's accuracy; EM estimates the accuracies and the share of good
documents. It needs only how often each pattern of votes occurs, at most
``2 ** heuristics`` rows counted over all documents, so the fit sees the whole
corpus and runs on a small table.

The posterior of a document's pattern is its weak label. A linear scorer over
hashed word shapes and
pairs of them is trained on posteriors of at most ``TRAIN_DOCS``
documents, those with the smallest id hashes, and then scores every text; it
also judges texts on which all heuristics are silent. No given label is used.

A null or empty text has no shapes and no votes; its score is the bias alone. The
score is a probability; texts under ``KEEP_LEVEL`` are rejected. Repeated rows
agree; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.scratch import materialize
from riskweave.llm.shingles import mix64, span_hashes, text_buffers, text_groups, word_spans

TRAIN_DOCS = 6000
SLOTS = 1 << 10
STEPS = 150
SHORT_TEXT = 4  # words added to every text's length: a few words are weak evidence
EM_STEPS = 200
KEEP_LEVEL = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ALNUM = _LETTER.copy()
_ALNUM[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


# --- heuristics -----------------------------------------------------------

def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """What the heuristics look at, per text."""
    n = len(offsets) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    start, end, doc = word_spans(data, offsets)
    per_text_letters = np.concatenate([[0], np.cumsum(_ALNUM[data], dtype=np.int64)])
    word = span_hashes(data, start, end)
    words = np.bincount(doc, minlength=n)
    single = end - start == 1
    last = data[end - 1]
    solid = per_text_letters[end] - per_text_letters[start] > 0
    tail = (end - start >= 4) & (per_text_letters[end] == per_text_letters[np.maximum(end - 3, start)])
    shout = (last == ord("!")) & (end - start >= 3)
    shout[shout] = data[end[shout] - 2] == ord("!")
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    _, one = np.unique(mix64(word + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    # letters over two bytes count twice, upper case only in ASCII: shares compare like with like
    return {"words": words, "letters": per_text(_LETTER[data]), "upper": per_text(_UPPER[data]), "marks": per_text(_MARK[data]),
            "stops": per_text(_STOP[data]), "bars": np.bincount(doc[single & (last == ord("|"))], minlength=n),
            "tails": np.bincount(doc[tail], minlength=n), "empty": np.bincount(doc[~solid], minlength=n),
            "shouts": np.bincount(doc[shout], minlength=n), "repeats": np.bincount(doc[again], minlength=n),
            "distinct": np.bincount(doc[one], minlength=n)}


HEURISTICS = ("upper", "shouts", "marks", "tails", "bars", "no_letters", "repeats", "stale", "sentences", "varied", "calm")
POLARITY = np.array([-1] * 8 + [1] * 3)


def votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, heuristics): 1 where the heuristic votes (its kind is in POLARITY), else 0."""
    words, letters = np.maximum(c["words"], 1), np.maximum(c["letters"], 1)
    upper = c["upper"] / letters
    shouts, marks, tails, bars, empty, repeats, stops, fresh = (
        c[k] / words for k in ("shouts", "marks", "tails", "bars", "empty", "repeats", "stops", "distinct"))
    some = c["words"] >= 20
    cast = [
        (upper > 0.25) & (c["words"] >= 4), shouts > 0.15, marks > 0.3, tails > 0.15, bars > 0.05, empty > 0.08,
        (repeats > 0.15) & some, some & (fresh < 0.25 * np.minimum(1.0, np.sqrt(2000 / words))),
        (stops > 0.02) & (stops < 0.4) & (upper < 0.1) & (marks < 0.05) & (repeats < 0.05),
        (fresh > 0.35) & (repeats < 0.05) & (empty < 0.03) & (tails < 0.05) & (upper < 0.2),
        (upper < 0.1) & (tails < 0.02) & (bars == 0) & (repeats < 0.05)]
    return (np.stack(cast, axis=1) & (c["words"] > 0)[:, None]).astype(np.int8)


# --- label model ----------------------------------------------------------

@dataclass
class LabelModel:
    """Share of good documents, and per heuristic the probability that a vote it casts is right."""

    prior: float
    accuracy: np.ndarray

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """Probability of good for every row of votes."""
        trust = POLARITY * np.log(self.accuracy / (1 - self.accuracy))
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + cast @ trust, -50, 50)))


def fit_labels(cast: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> LabelModel:
    """EM on the patterns of votes; heuristics are taken to be better than chance and never certain."""
    model = LabelModel(0.5, np.full(len(POLARITY), 0.8))
    p = model.posterior(cast)
    for _ in range(steps):
        right = np.where(POLARITY > 0, p[:, None], 1 - p[:, None])
        votes_cast = (counts[:, None] * cast).sum(axis=0)
        accuracy = ((counts[:, None] * cast * right).sum(axis=0) + 4) / (votes_cast + 5)
        prior = float((counts @ p + 1) / (counts.sum() + 2))
        model = LabelModel(min(max(prior, 0.01), 0.99), np.clip(accuracy, 0.6, 0.99))
        new = model.posterior(cast)
        if np.abs(new - p).max(initial=0.0) < 1e-9:
            break
        p = new
    return model


# --- scorer ---------------------------------------------------------------

def shape_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2, words) hash slots of every word's shape and of the shapes of it and the word before; text index.

    A shape is the case, the kind of ending, the length class, and whether the
    word repeats the one before.
    """
    start, end, doc = word_spans(data, offsets)
    if not len(start):
        return np.zeros((2, 0), np.int64), doc
    word = span_hashes(data, start, end)

    def inside(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])
        return total[b] - total[a]

    upper, letters = inside(_UPPER, start, end), inside(_LETTER, start, end)
    case = np.select([letters == 0, upper == 0, (upper == 1) & _UPPER[data[start]], 5 * upper >= 3 * letters], [0, 1, 2, 3], 4)
    last = data[end - 1]
    long_tail = (end - start >= 4) & (inside(_ALNUM, np.maximum(end - 3, start), end) == 0)
    ending = np.select([long_tail, _ALNUM[last], (last == ord(",")) | (last == ord(";")) | (last == ord(":")),
                        (last == ord(".")) | (last == ord("?")), last == ord("!")], [5, 0, 1, 2, 3], 4)
    size = np.minimum(np.log2(end - start).astype(np.int64), 5)
    follows = np.concatenate([[False], doc[1:] == doc[:-1]])
    same = follows & np.concatenate([[False], word[1:] == word[:-1]])
    shape = ((case * 6 + ending) * 6 + size) * 2 + same + 1
    before = np.where(follows, np.concatenate([[0], shape[:-1]]), 0)
    codes = np.stack([shape, before * 1024 + shape + (1 << 20)]).astype(np.uint64)
    return (mix64(codes) % np.uint64(SLOTS)).astype(np.int64), doc


@dataclass
class Scorer:
    """Mean weight of a text's shapes plus ``bias``, as log odds of being good."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS))
    bias: float = 0.0

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        slots, doc = shape_slots(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(doc, self.weights[slots].sum(axis=0), n) / (np.bincount(doc, minlength=n) + SHORT_TEXT)
        return 1 / (1 + np.exp(-np.clip(self.bias + total, -50, 50)))


def shape_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SLOTS) occurrences of hashed shapes per word."""
    slots, doc = shape_slots(data, offsets)
    n = len(offsets) - 1
    words = np.bincount(doc, minlength=n) + SHORT_TEXT
    counts = np.bincount((doc[None, :] * SLOTS + slots).ravel(), minlength=n * SLOTS).reshape(n, SLOTS)
    return (counts / words[:, None]).astype(np.float32)


def train_scorer(shares: np.ndarray, target: np.ndarray, steps: int = STEPS, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on posteriors, both classes weighing the same; frequencies are scaled by their spread."""
    if not len(target) or target.max() - target.min() < 0.5:
        return Scorer(bias=float(np.log((target.sum() + 1) / ((1 - target).sum() + 1))) if len(target) else 0.0)
    middle, spread = shares.mean(axis=0), shares.std(axis=0) + 1e-4
    x = (shares - middle) / spread
    weight = np.where(target >= 0.5, 0.5 / max((target >= 0.5).sum(), 1), 0.5 / max((target < 0.5).sum(), 1)).astype(np.float32)
    w, b = np.zeros(SLOTS, np.float32), 0.0
    m1, m2 = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for step in range(1, steps + 1):
        gap = weight * (target - 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))).astype(np.float32)
        grad = np.append(gap @ x - ridge * w, gap.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        move = 0.02 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-9)
        w, b = w + move[:-1].astype(np.float32), b + move[-1]
    scaled = w / spread
    return Scorer(scaled.astype(float), float(b - middle @ scaled))


# --- jobs -----------------------------------------------------------------

def cast_votes(docs: DataFrame, text: str = "text", out: str = "votes") -> DataFrame:
    """Adds ``out``: every heuristic's vote, as a string of 0 (silent) and 1 in the order of HEURISTICS."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(names.index(text)))
            for lo, hi in text_groups(offsets):
                own = offsets[lo:hi + 1]
                cast = votes(text_counts(data[own[0]:own[-1]], own - own[0])) + ord("0")
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(
                    [bytes(v).decode() for v in cast.astype(np.uint8)])], [*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def _patterns(votes_: list[str]) -> np.ndarray:
    return np.array([[int(d) for d in v] for v in votes_], np.int8).reshape(-1, len(POLARITY))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[LabelModel, Scorer]:
    """Label model from the votes of all documents, scorer from at most ``train_docs`` different ones.

    A document is its id and text (``mark``, their hash), so each text is learnt with its own
    posterior, whatever ids repeat or are null.
    """
    marked = docs.select(F.xxhash64("doc_id", "text").alias("mark"), "text")
    sided = materialize(cast_votes(marked).select("mark", "votes"), "votes")
    cast = sided.groupBy("votes").count().collect()  # at most 2 ** heuristics rows
    patterns, counts = _patterns([r["votes"] for r in cast]), np.array([r["count"] for r in cast], float)
    if not len(counts):
        return LabelModel(0.5, np.full(len(POLARITY), 0.8)), Scorer()
    model = fit_labels(patterns, counts)
    # half of the sample from each side of the label model, so that a rare class is seen
    good = [r["votes"] for r, p in zip(cast, model.posterior(patterns)) if p >= 0.5]
    sided = sided.dropDuplicates(["mark"]).withColumn("_good", F.col("votes").isin(good))
    picked = None
    for side in (True, False):
        some = sided.where(F.col("_good") == side).drop("_good").orderBy("mark").limit(train_docs // 2)
        picked = some if picked is None else picked.union(some)
    sample = picked.toPandas()  # at most train_docs marks and patterns
    wanted = docs.sparkSession.createDataFrame(sample[["mark"]], "mark long")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in text_groups(offsets):
                own = offsets[lo:hi + 1]
                part = shape_shares(data[own[0]:own[-1]], own - own[0]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in part], pa.binary())],
                                                 ["mark", "shares"])

    # the broadcast side has at most train_docs marks; a row of shares has 2 * SLOTS bytes
    rows = marked.join(F.broadcast(wanted), "mark").dropDuplicates(["mark"]).mapInArrow(shares, "mark long, shares binary").toPandas()
    target = dict(zip(sample["mark"], model.posterior(_patterns(sample["votes"].tolist()))))
    rows = rows.sort_values("mark")
    x = np.frombuffer(b"".join(rows["shares"]), np.float16).reshape(-1, SLOTS).astype(np.float32)
    return model, train_scorer(x, np.array([target[i] for i in rows["mark"]]))


def score_documents(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "quality") -> DataFrame:
    """Adds ``out``: the scorer's probability that the text is good."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(names.index(text)))
            for lo, hi in text_groups(offsets):
                own = offsets[lo:hi + 1]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(
                    scorer.score(data[own[0]:own[-1]], own - own[0]))], [*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows of ``docs`` that the scorer doesn't reject."""
    _, scorer = fit(docs)
    return score_documents(docs, scorer, out="_ql_score").where(F.col("_ql_score") >= KEEP_LEVEL).select(*docs.columns)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Every text of documents: doc_id, votes, weak_label (posterior), score, keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, scorer = fit(docs)
    # the posterior in column expressions: prior and trust of the votes cast
    trust = POLARITY * np.log(model.accuracy / (1 - model.accuracy))
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for k, t in enumerate(trust.tolist(), 1):
        odds = odds + F.when(F.substring("votes", k, 1) == "1", t).otherwise(0.0)
    scored = score_documents(cast_votes(docs), scorer, out="score").drop("text")
    return scored.select("doc_id", "votes", (1 / (1 + F.exp(-odds))).alias("weak_label"), "score",
                         (F.col("score") >= KEEP_LEVEL).alias("keep"))
