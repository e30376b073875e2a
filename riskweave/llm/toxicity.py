"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, digits and bytes over 0x7F. A chain of two states
(clean, toxic) runs over the tokens of a text; a token's features are its
lower-cased form, prefixes of four to six bytes, and its last three bytes,
hashed into one table of weights.

Labels come per document, so tokens are labelled first: features that are far
more frequent in toxic than in clean training documents mark their tokens, and
a greedy cover adds features until every toxic document it can explain has a
marked token. The field is then trained by gradient steps on the exact
likelihood; the expectations come from forward-backward.

A text is scored by its most toxic token: the largest marginal probability of
the toxic state. Tokens over ``SPAN_LEVEL`` are its offending spans, adjacent
ones merged, as code point offsets.

Forward and backward recursions are linear fractional maps of the odds. All
tokens of a block of texts are one chain with resets; it is cut in about
sqrt(n) pieces, whose maps are composed side by side, so no Python loop runs
over tokens and a single very long text costs no more per token.

Training takes at most ``TRAIN_DOCS`` toxic documents and ``CLEAN_PER_TOXIC``
times as many clean ones, those with the smallest id hashes; rows with a null label are left out. Without both labels
nothing can be learnt and all scores are 0. A null or empty text scores 0
without spans. Rows are scored one by one, so repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.shingles import span_hashes, text_buffers, text_groups, word_spans

TRAIN_DOCS = 1500
CLEAN_PER_TOXIC = 3
TABLE = 1 << 20
STEPS = 60
SPAN_LEVEL = 0.3
TRAIN_BLOCK_BYTES = 2 << 20
HELD_OUT = 2  # crc32(doc_id) mod 4 of rows never learnt from
PREFIXES = (4, 5, 6)

_GAPS = np.ones(256, bool)
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = False


# --- features -------------------------------------------------------------

def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, text index, features: one row of table slots per kind; slot 0 is 'none')."""
    start, end, doc = word_spans(data, offsets, _GAPS)
    size = end - start
    kinds = [(start, end, size > 0)]
    kinds += [(start, np.minimum(start + n, end), size >= n) for n in PREFIXES]
    kinds.append((np.maximum(end - 3, start), end, size >= 3))
    slots = np.zeros((len(kinds), len(start)), np.int64)
    for k, (a, b, has) in enumerate(kinds):
        h = span_hashes(data, a, b) ^ np.uint64(0x632BE59BD9B4E019 * (k + 1) & (1 << 64) - 1)
        slots[k] = np.where(has, (h % np.uint64(TABLE - 1)).astype(np.int64) + 1, 0)
    return start, end, doc, slots


# --- forward and backward -------------------------------------------------

def _chain(num_x: np.ndarray, num_1: np.ndarray, den_x: np.ndarray, den_1: np.ndarray) -> np.ndarray:
    """x[t] = (num_x[t] * x[t-1] + num_1[t]) / (den_x[t] * x[t-1] + den_1[t]) with x[-1] = 1, for all t."""
    n = len(num_x)
    if not n:
        return np.zeros(0)
    steps = max(1, int(np.sqrt(n)))
    pieces = -(-n // steps)

    def laid(v, fill):  # one column per piece; the identity map fills up the last
        out = np.full(pieces * steps, fill)
        out[:n] = v
        return np.ascontiguousarray(out.reshape(pieces, steps).T)

    p, q, r, s = laid(num_x, 1.0), laid(num_1, 0.0), laid(den_x, 0.0), laid(den_1, 1.0)
    a, b, c, d = np.ones(pieces), np.zeros(pieces), np.zeros(pieces), np.ones(pieces)
    for t in range(steps):  # the composed map of every piece
        a, b, c, d = p[t] * a + q[t] * c, p[t] * b + q[t] * d, r[t] * a + s[t] * c, r[t] * b + s[t] * d
        scale = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / scale, b / scale, c / scale, d / scale
    x, enter = 1.0, np.empty(pieces)
    for k in range(pieces):
        enter[k] = x
        x = (a[k] * x + b[k]) / (c[k] * x + d[k])
    out, x = np.empty((steps, pieces)), enter
    for t in range(steps):
        x = (p[t] * x + q[t]) / (r[t] * x + s[t])
        out[t] = x
    return out.T.reshape(-1)[:n]


@dataclass
class Field:
    """Weights of the toxic state by feature slot; ``trans`` are log weights (from, to), ``start`` the log odds.

    ``prior`` corrects marginal odds for a training sample with another share of toxic texts.
    """

    weights: np.ndarray
    trans: np.ndarray
    start: float
    prior: float = 1.0

    def odds(self, slots: np.ndarray) -> np.ndarray:
        score = np.zeros(slots.shape[1])
        for row in slots:
            score += self.weights[row]
        return np.exp(np.clip(score, -30, 30))

    def forward_backward(self, odds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Odds of the toxic state given the tokens up to, and after, each one. ``first``: starts of texts."""
        m = np.exp(self.trans)
        fresh = odds * np.exp(self.start)
        fwd = _chain(np.where(first, 0.0, odds * m[1, 1]), np.where(first, fresh, odds * m[0, 1]),
                     np.where(first, 0.0, m[1, 0]), np.where(first, 1.0, m[0, 0]))
        ahead = np.append(odds[1:], 1.0)  # odds of the token after
        last = np.append(first[1:], True)
        back = _chain(np.where(last, 0.0, ahead * m[1, 1])[::-1], np.where(last, 1.0, m[1, 0])[::-1],
                      np.where(last, 0.0, ahead * m[0, 1])[::-1], np.where(last, 1.0, m[0, 0])[::-1])[::-1]
        return fwd, back

    def marginals(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        fwd, back = self.forward_backward(self.odds(slots), first)
        both = fwd * back * self.prior
        return both / (1 + both)


def _firsts(doc: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)


# --- training -------------------------------------------------------------

def mark_features(slot: np.ndarray, whose: np.ndarray, in_clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which table slots mark a token of a toxic text.

    ``slot``, ``whose``: the distinct (slot, text) pairs of toxic texts; ``in_clean``: clean texts by slot.
    """
    in_toxic = np.bincount(slot, minlength=TABLE)
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    sharp = in_clean / n_clean <= 0.02 * in_toxic / n_toxic
    sharp[0] = False
    chosen = sharp & (in_toxic >= max(4.0, 0.03 * n_toxic))
    useful = sharp[slot]
    slot, whose = slot[useful], whose[useful]
    covered = np.zeros(len(toxic), bool)
    covered[whose[chosen[slot]]] = True
    while True:  # greedy cover of the toxic texts left
        gain = np.bincount(slot[~covered[whose]], minlength=TABLE)
        best = int(gain.argmax())
        if gain[best] < max(3, 0.002 * n_toxic):
            return chosen
        chosen[best] = True
        covered[whose[slot == best]] = True


@dataclass
class _Block:
    """Tokens of some training texts: number of the distinct token, label, start of a text."""

    kind: np.ndarray
    label: np.ndarray
    first: np.ndarray


def _training_blocks(batches: Iterable[tuple[Sequence[str], np.ndarray]]) -> tuple[list[_Block], np.ndarray, np.ndarray]:
    """(blocks, slots by distinct token, toxic): texts pass in blocks and only token numbers are kept."""
    keys, columns, parts, pairs, in_clean = [], [], [], [], np.zeros(TABLE, np.int64)
    flags, done = [np.zeros(0, bool)], 0
    for texts, own_flags in batches:
        data, offsets = text_buffers(pa.array(texts, pa.large_string()))
        flags.append(np.asarray(own_flags, bool))
        for lo, hi in text_groups(offsets, TRAIN_BLOCK_BYTES):
            own = offsets[lo:hi + 1]
            _, _, doc, slots = token_features(data[own[0]:own[-1]], own - own[0])
            doc = doc + lo
            key = slots[0].astype(np.uint64)
            for row in slots[1:]:
                key = key * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64)
            key, at, kind = np.unique(key, return_index=True, return_inverse=True)
            keys.append(key)
            columns.append(slots[:, at].astype(np.int32))
            parts.append((kind.astype(np.int32), (doc + done).astype(np.int32)))
            pair = np.unique((slots << 32 | doc[None, :]).ravel())
            bad = flags[-1][pair & (1 << 32) - 1]
            in_clean += np.bincount(pair[~bad] >> 32, minlength=TABLE)
            pairs.append(pair[bad] + done)
        done += len(flags[-1])
    toxic = np.concatenate(flags)
    if not keys:
        return [], np.zeros((0, 0), np.int32), toxic
    _, at, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    by_kind = np.concatenate(columns, axis=1)[:, at]
    pair = np.concatenate(pairs)
    marks = mark_features(pair >> 32, pair & (1 << 32) - 1, in_clean, toxic)[by_kind].any(axis=0)
    blocks, base = [], 0
    for (kind, doc), key in zip(parts, keys):
        kind = number[base:base + len(key)].astype(np.int32)[kind]
        base += len(key)
        blocks.append(_Block(kind, marks[kind] & toxic[doc], _firsts(doc)))
    return blocks, by_kind, toxic


def train(batches: Iterable[tuple[Sequence[str], np.ndarray]], steps: int = STEPS, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Fit the field to documents' labels, from batches of (texts, whether toxic). Nothing else goes in."""
    blocks, by_kind, toxic = _training_blocks(batches)
    if not blocks or not by_kind.size or toxic.all() or not toxic.any():
        return Field(np.zeros(TABLE), np.array([[0.0, -60.0], [0.0, -60.0]]), -60.0)
    used, compact = np.unique(by_kind, return_inverse=True)
    compact = compact.reshape(by_kind.shape)
    w_end = len(used)
    seen, labelled = np.zeros((2, 2)), 0
    for b in blocks:
        t = np.flatnonzero(~b.first)
        seen += np.bincount(2 * b.label[t - 1] + b.label[t], minlength=4).reshape(2, 2)
        labelled += int(b.label.sum())
    floor = np.maximum(seen, 0.5)
    params = np.concatenate([np.zeros(w_end), np.log(floor / floor.sum(1, keepdims=True)).ravel(), [-3.0]])
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        field = Field(params[:w_end], params[w_end:-1].reshape(2, 2), params[-1])
        by_token = field.odds(compact)
        m = np.exp(field.trans)
        grad, gap = np.zeros_like(params), np.zeros(compact.shape[1])
        expected = np.zeros((2, 2))
        for b in blocks:
            odds = by_token[b.kind]
            fwd, back = field.forward_backward(odds, b.first)
            both = fwd * back
            diff = b.label - both / (1 + both)
            gap += np.bincount(b.kind, diff, len(gap))
            grad[-1] += diff[b.first].sum()
            t = np.flatnonzero(~b.first)  # pairwise marginals from the odds on either side
            f, ahead = fwd[t - 1], odds[t] * back[t]
            total = m[0, 0] + m[0, 1] * ahead + m[1, 0] * f + m[1, 1] * f * ahead
            expected += [[(m[0, 0] / total).sum(), (m[0, 1] * ahead / total).sum()],
                         [(m[1, 0] * f / total).sum(), (m[1, 1] * f * ahead / total).sum()]]
        for row in compact:
            grad[:w_end] += np.bincount(row, gap, w_end)
        grad[:w_end][used == 0] = 0.0
        grad[w_end:-1] = (seen - expected).ravel()
        grad /= max(1, labelled)
        grad[:w_end] -= ridge * params[:w_end]
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        params = params + rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(TABLE)
    weights[used] = params[:w_end]
    weights[0] = 0.0
    return Field(weights, params[w_end:-1].reshape(2, 2), float(params[-1]))


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """Train on at most ``train_docs`` toxic labelled documents and clean ones in proportion, none held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(
        "doc_id", (F.col("toxic") == 1).alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for kind in (True, False):
        some = usable.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs if kind else CLEAN_PER_TOXIC * train_docs)
        picked = some if picked is None else picked.union(some)
    # at most (1 + CLEAN_PER_TOXIC) * train_docs rows of an id and a flag, so the broadcast is bounded
    # of texts that share an id the least stands
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = [np.zeros(0, bool)]

        def batches() -> Iterator[tuple[list[str], np.ndarray]]:
            for frame in frames:
                flags.append(frame["toxic"].to_numpy(bool))
                yield [t or "" for t in frame["text"]], flags[-1]

        field = train(batches())
        toxic = np.concatenate(flags)
        slots = np.flatnonzero(field.weights)
        yield pd.DataFrame({"slots": [slots.astype(np.int32).tobytes()], "weights": [field.weights[slots].tobytes()],
                            "trans": [field.trans.tobytes()], "start": [field.start], "n_toxic": [int(toxic.sum())],
                            "n_clean": [int((~toxic).sum())]})

    # the bounded sample is learnt from in one task, away from the driver's memory; its texts pass in order of
    # their ids, an Arrow batch at a time, and only token numbers are kept
    got = rows.coalesce(1).sortWithinPartitions("doc_id").mapInPandas(
        learn, "slots binary, weights binary, trans binary, start double, n_toxic long, n_clean long").collect()
    field = Field(np.zeros(TABLE), np.array([[0.0, -60.0], [0.0, -60.0]]), -60.0)
    if got:
        (r,) = got
        field.weights[np.frombuffer(r["slots"], np.int32)] = np.frombuffer(r["weights"])
        field = Field(field.weights, np.frombuffer(r["trans"]).reshape(2, 2), r["start"])
        share = dict(usable.groupBy("toxic").count().collect())  # of all labels
        if len(share) == 2 and r["n_toxic"] and r["n_clean"]:
            field.prior = share[True] / share[False] * r["n_clean"] / r["n_toxic"]
    return field


# --- scoring --------------------------------------------------------------

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("probability", T.DoubleType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def score_block(field: Field, data: np.ndarray, offsets: np.ndarray, level: float = SPAN_LEVEL) -> tuple[np.ndarray, list]:
    """(score, spans) of every text of a block."""
    n = len(offsets) - 1
    start, end, doc, slots = token_features(data, offsets)
    p = field.marginals(slots, _firsts(doc))
    score = np.zeros(n)
    np.maximum.at(score, doc, p)
    spans: list[list[dict]] = [[] for _ in range(n)]
    hit = np.flatnonzero(p >= level)
    if len(hit):
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        previous = -2
        for t in hit.tolist():
            d = int(doc[t])
            own = spans[d]
            a, b = int(chars[start[t]] - chars[offsets[d]]), int(chars[end[t]] - chars[offsets[d]])
            if previous == t - 1 and own:  # the token before belongs to the same span
                own[-1] = {"start": own[-1]["start"], "end": b, "probability": max(own[-1]["probability"], float(p[t]))}
            else:
                own.append({"start": a, "end": b, "probability": float(p[t])})
            previous = t
    return score, spans


def score_documents(docs: DataFrame, field: Field, text: str = "text", score: str = "score", spans: str = "spans") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``spans`` (offending code point ranges) to every row."""
    names = docs.columns
    weights = field.weights.astype(np.float32)
    small = Field(weights, field.trans, field.start, field.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(names.index(text)))
            for lo, hi in text_groups(offsets):
                own = offsets[lo:hi + 1]
                values, found = score_block(small, data[own[0]:own[-1]], own - own[0])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(values), pa.array(found, _ARROW_SPANS)],
                                                 [*names, score, spans])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(spans, SPANS)]))


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows of ``docs`` that aren't predicted toxic."""
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, field, score="_tx_score", spans="_tx_spans").where(F.col("_tx_score") < SPAN_LEVEL).select(*docs.columns)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents scored: doc_id, held_out, score, predicted, n_spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs.withColumnRenamed("text", "_tx_text"), field, "_tx_text").drop("_tx_text")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= SPAN_LEVEL).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
