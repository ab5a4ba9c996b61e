"""Toxic spans by a linear-chain conditional random field, and documents scored from its marginals.

Tokens are runs of letters, digits and non-ASCII bytes of the lower-cased text. Features are the token itself and its
first 4, 5 and 6 bytes, hashed. Labels come by document, so labelled tokens are drawn first: features whose presence
tells toxic documents from clean ones (smoothed log odds over the fitting sample) mark the tokens of toxic documents
that carry them. A two-state chain is fitted to those by gradient ascent on the conditional likelihood. Only features with
weight matter, and between two tokens that have any the chain is a power of one 2 x 2 matrix, so forward-backward over
a text of any length visits those tokens alone and is still exact.

A document's score is a logistic function of its largest marginal and of the marginals' sum, fitted on the same sample.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, SpanHasher, bounded_batches, documents
from .pretoken import batches, text_runs

PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: The largest fitting sample, in documents of each label. The sample is the labelled rows of smallest hash.
MOST_TOXIC, MOST_CLEAN = 1500, 3000
#: The bytes of text that the sample's documents, in the order of the hash, may have together; each is taken whole.
MOST_BYTES = 64 << 20
MOST_FEATURES = 4096
#: Of the chains without a telling feature every so many-th takes part in the fit.
EVERY = 40

_TOKEN = np.ones(256, bool)
_TOKEN[:128] = [chr(i).isalnum() for i in range(128)]


class Tokens:
    """Tokens of many texts: text number, start and end (bytes of the lower-cased text) and feature hashes (tokens, 1 + prefixes)."""

    hasher = SpanHasher(seed=41)

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        solid = np.concatenate([[False], _TOKEN[buf], [False]])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.first = np.searchsorted(self.start, bounds)  # of each text, and the end
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.features = np.stack([self.hasher(buf, self.start, self.end)] + [self.hasher(buf, self.start, np.minimum(self.start + k, self.end)) ^ np.uint64(k) for k in PREFIXES], 1)
        self.start, self.end = self.start - bounds[self.text], self.end - bounds[self.text]


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # of each for state 1
    bias: float  # of state 1
    trans: np.ndarray  # (2, 2) log potentials
    doc: np.ndarray  # intercept, largest marginal's logit, log of the marginals' sum

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Log potential of state 1 against state 0 beyond the bias."""
        if not len(self.keys):
            return np.zeros(len(features))
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        return np.where(self.keys[at] == features, self.weights[at], 0.0).sum(1)


def chain_marginals(places: np.ndarray, emit: np.ndarray, n: int, bias: float, trans: np.ndarray) -> np.ndarray:
    """P(state 1) at the given places of a chain of n tokens whose other tokens have no emission."""
    step = np.exp(trans) * np.array([1.0, np.exp(bias)])  # to a token without features
    (l0, l1), vec = np.linalg.eig(step)
    if l0 < l1:
        l0, l1, vec = l1, l0, vec[:, ::-1]
    back = np.linalg.inv(vec)
    main, rest, ratio = np.outer(vec[:, 0], back[0]), np.outer(vec[:, 1], back[1]), l1 / l0

    def power(k):
        return main + (ratio**k) * rest

    own = np.stack([np.ones(len(emit)), np.exp(np.clip(emit, -30, 30))], 1)
    m = len(places)
    forward, backward = np.empty((m, 2)), np.empty((m, 2))
    state, at = np.array([1.0, np.exp(bias)]), 0
    for k in range(m):
        if places[k] > at:
            state = state @ power(places[k] - at)
            at = places[k]
        state = state * own[k]
        state = state / state.sum()
        forward[k] = state
    state, at = np.ones(2), n - 1
    for k in range(m - 1, -1, -1):
        if at > places[k]:
            state = power(at - places[k]) @ state
            at = places[k]
        backward[k] = state / state.sum()
        state = backward[k] * own[k]
    both = forward * backward
    return both[:, 1] / both.sum(1)


def _chain_gradient(features, labels, lengths, weights, bias, trans):
    """Log likelihood's gradient over padded chains. features: per-token emission ids as (token, id) pairs."""
    token, fid, first = features
    emit = np.zeros(len(labels))
    np.add.at(emit, token, weights[fid])
    emit += bias
    n, most = len(lengths), int(lengths.max())
    grid = np.zeros((n, most))
    mask = np.arange(most) < lengths[:, None]
    grid[mask] = emit
    e = np.stack([np.ones_like(grid), np.exp(np.clip(grid, -30, 30))], 2)
    t = np.exp(trans)
    f, b = np.zeros((n, most, 2)), np.ones((n, most, 2))
    f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for k in range(1, most):
        x = (f[:, k - 1] @ t) * e[:, k]
        f[:, k] = np.where(mask[:, k, None], x / x.sum(1, keepdims=True), f[:, k - 1])
    for k in range(most - 2, -1, -1):
        x = (b[:, k + 1] * e[:, k + 1]) @ t.T
        b[:, k] = np.where(mask[:, k + 1, None], x / x.sum(1, keepdims=True), 1.0)
    p = f * b
    p /= p.sum(2, keepdims=True)
    p1 = p[:, :, 1][mask]
    pair = f[:, :-1, :, None] * t * (e * b)[:, 1:, None, :]
    pair = pair / np.maximum(pair.sum((2, 3), keepdims=True), 1e-300) * mask[:, 1:, None, None]
    y = np.zeros((n, most), int)
    y[mask] = labels
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
    miss = labels - p1
    gw = np.zeros(len(weights))
    np.add.at(gw, fid, miss[token])
    return gw, miss.sum(), seen - pair.sum((0, 1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _document_features(marginals: np.ndarray) -> tuple[float, float, float]:
    top = float(np.clip(marginals.max(), 1e-4, 1 - 1e-4)) if len(marginals) else 1e-4
    return 1.0, float(np.log(top / (1 - top))), float(np.log(1e-2 + marginals.sum())) if len(marginals) else float(np.log(1e-2))


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The chain fitted on all examples, the document layer on marginals from chains that did not see the document.

    Without examples of both labels every score is low and constant.
    """
    y = np.array(toxic, int)
    model = fit_chain(texts, y)
    if not len(model.keys):
        return model
    rank = np.empty(len(y), int)  # halves with as many of either label
    for v in (0, 1):
        own = np.flatnonzero(y == v)
        rank[own] = np.arange(len(own)) % 2
    x = np.zeros((len(y), 3))
    for half in (0, 1):
        seen, new = np.flatnonzero(rank != half), np.flatnonzero(rank == half)
        other, some = fit_chain([texts[i] for i in seen], y[seen]), [texts[i].lower().encode() for i in new]
        for i, j in batches(some, BLOCK_BYTES):
            x[new[i:j]] = [_document_features(m) for _, m in marginals(Tokens(some[i:j]), other, j - i)]
    w, ridge = np.zeros(3), np.diag([0.01, 0.3, 0.3])
    for _ in range(40):  # Newton's steps
        p = _sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    model.doc = w
    return model


def fit_chain(texts: list[str], y: np.ndarray, chain: int = 24, steps: int = 60) -> Model:
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -6.0, np.zeros((2, 2)), np.array([-4.0, 0, 0]))
    if not len(y) or y.min() == y.max():
        return empty
    low = [t.lower().encode() for t in texts]
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    # features of enough toxic documents, and in how many clean ones they are; a block of texts at a time
    toxic_texts = np.flatnonzero(y == 1)
    carried = [np.unique(tok.features[a:b]) for tok in _blocks([low[i] for i in toxic_texts]) for a, b in zip(tok.first, tok.first[1:], strict=False)]
    keys, pos = np.unique(np.concatenate(carried), return_counts=True)
    number, keys, pos = len(keys), keys[pos >= 4], pos[pos >= 4]
    if not len(keys):
        return empty
    neg = np.zeros(len(keys), np.int64)
    for tok in _blocks([low[i] for i in np.flatnonzero(y == 0)]):
        for a, b in zip(tok.first, tok.first[1:], strict=False):
            at = _at(keys, np.unique(tok.features[a:b]))
            neg[at[at >= 0]] += 1
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    # a feature counts only if its split between labels is no accident among this many features
    # (with few examples the bar is lower, and the document layer learns to trust single hits less)
    both, share = pos + neg, n1 / len(y)
    surprise = pos * np.log(pos / both / share) + neg * np.log(np.maximum(neg, 1e-9) / both / (1 - share))
    telling = np.flatnonzero((odds > 2.5) & (surprise > min(np.log(4 * number) + 2, 2 + 0.15 * n1)))
    telling = _needed(telling[np.argsort(-surprise[telling], kind="stable")[:MOST_FEATURES]], [_at(keys, c) for c in carried])
    if not len(telling):
        return empty
    keys = keys[telling]
    # chains around the tokens that carry a telling feature, and as many drawn evenly from the rest
    labels, lengths, token, feature, size, seen = [], [], [], [], 0, 0
    done = 0
    for tok in _blocks(low):
        n = len(tok.first) - 1
        at = _at(keys, tok.features)
        label = ((at >= 0).any(1) & (y[done + tok.text] == 1)).astype(float)
        chains = np.arange(-(-len(label) // chain))
        hit = np.bincount(np.flatnonzero((at >= 0).any(1)) // chain, minlength=len(chains)) > 0
        for c in chains[hit | ((chains + seen) % EVERY == 0)].tolist():
            own = slice(c * chain, min((c + 1) * chain, len(label)))
            rows, cols = np.nonzero(at[own] >= 0)
            labels.append(label[own])
            lengths.append(len(label[own]))
            token.append(rows + size)
            feature.append(at[own][rows, cols])
            size += lengths[-1]
        seen, done = seen + len(chains), done + n
    feats, label, lengths = (np.concatenate(token), np.concatenate(feature), None), np.concatenate(labels), np.array(lengths)
    weights, bias, trans = np.zeros(len(keys)), -3.0, np.zeros((2, 2))
    gsum = [np.full(len(keys), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    for _ in range(steps):
        gw, gb, gt = _chain_gradient(feats, label, lengths, weights, bias, trans)
        gw, gt = gw - 0.05 * weights, gt - 0.5 * trans
        gsum = [gsum[0] + gw**2, gsum[1] + gb**2, gsum[2] + gt**2]  # adaptive steps
        weights, bias, trans = weights + 0.5 * gw / np.sqrt(gsum[0]), bias + 0.5 * gb / np.sqrt(gsum[1]), trans + 0.2 * gt / np.sqrt(gsum[2])
    return Model(keys, weights, float(bias), trans, np.array([-4.0, 0, 0]))


def _blocks(texts: list[bytes]):
    for i, j in batches(texts, BLOCK_BYTES):
        yield Tokens(texts[i:j])


def _at(keys: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Places among the sorted keys, -1 for what is not there."""
    at = np.minimum(np.searchsorted(keys, features), len(keys) - 1)
    return np.where(keys[at] == features, at, -1)


def _needed(ordered: np.ndarray, carried: list[np.ndarray], each: int = 14) -> np.ndarray:
    """Of features in falling order those that toxic documents need, until each document has enough.

    Near copies share all their rare words, and those would otherwise pass for signs of toxicity. carried: per
    toxic document the numbers of its features.
    """
    own = [c[np.isin(c, ordered)] for c in carried]
    feature, text = np.concatenate(own), np.repeat(np.arange(len(own)), [len(c) for c in own])
    order = np.argsort(feature, kind="stable")
    feature, text = feature[order], text[order]
    out, lacks = [], np.full(len(carried), each)
    for f in ordered.tolist():
        docs = text[np.searchsorted(feature, f) : np.searchsorted(feature, f, side="right")]
        if (lacks[docs] > 0).sum() >= max(2, len(docs) / 4):
            out.append(f)
            lacks[docs] -= 1
    return np.sort(np.array(out, int))


def marginals(tok: Tokens, model: Model, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the tokens (numbers within ``tok``) that have weight, and their marginals."""
    emit = model.emissions(tok.features)
    events = np.flatnonzero(emit != 0)
    at = np.searchsorted(events, tok.first)
    out = []
    for i in range(n):
        own = events[at[i] : at[i + 1]]
        size = int(tok.first[i + 1] - tok.first[i])
        out.append((own, chain_marginals(own - tok.first[i], emit[own], size, model.bias, model.trans) if len(own) else np.zeros(0)))
    return out


def score_texts(texts: list[str], model: Model) -> tuple[np.ndarray, list[list[list[int]]]]:
    """Scores, and the offending spans as [first byte, byte after the last] of the UTF-8 text."""
    scores, spans = np.zeros(len(texts)), []
    low = [t.lower().encode() for t in texts]
    for i, j in batches(low, BLOCK_BYTES):
        tok = Tokens(low[i:j])
        for k, (own, m) in enumerate(marginals(tok, model, j - i)):
            scores[i + k] = _sigmoid(np.dot(_document_features(m), model.doc))
            found: list[list[int]] = []
            last = -2
            for t in own[m >= 0.5].tolist():
                if t == last + 1 and found:
                    found[-1][1] = int(tok.end[t])
                else:
                    found.append([int(tok.start[t]), int(tok.end[t])])
                last = t
            spans.append(in_original(texts[i + k], found) if found else found)
    return scores, spans


def in_original(text: str, spans: list[list[int]]) -> list[list[int]]:
    """Spans of the lower-cased text's bytes as spans of the text's own bytes; a character is in or out as a whole."""
    if text.isascii():
        return spans
    width = np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
    lower = np.fromiter((len(c.lower().encode()) for c in text), np.int64, len(text))
    if (width == lower).all():
        return spans
    at, own = np.concatenate([[0], np.cumsum(lower)]), np.concatenate([[0], np.cumsum(width)])
    return [[int(own[np.searchsorted(at, a, side="right") - 1]), int(own[np.searchsorted(at, b)])] for a, b in spans]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the labelled rows that are not held out, MOST_TOXIC and MOST_CLEAN of them at most."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    usable = usable.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    sample = usable.filter("toxic = 1").orderBy(order, "doc_id").limit(MOST_TOXIC).unionByName(usable.filter("toxic = 0").orderBy(order, "doc_id").limit(MOST_CLEAN))
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # MOST_TOXIC + MOST_CLEAN rows at most
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.orderBy(order, "doc_id", "text").rowsBetween(W.unboundedPreceding, 0))
    wanted = wanted.withColumn("_upto", upto).filter(F.col("_upto") <= MOST_BYTES)
    rows = sorted((r for r in wanted.collect()), key=lambda r: (r.doc_id, r.text or ""))
    return fit([r.text or "" for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row of docs(doc_id, text).

    Null and empty texts get the score of a text without any telling token. Null doc_id counts as the text "None"
    for held_out. Repeated rows each get their own equal row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches_in):
        for batch in batches_in:
            ids, got, spans = batch.column("doc_id").to_pylist(), [], []
            for _, _, texts in text_runs(batch):
                some, where = score_texts([t.decode() for t in texts], shared.value)
                got.append(some)
                spans += where
            got = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([held_out(i) for i in ids]), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32)), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["doc_id", "held_out", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<array<long>>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, and ``spans``: the offending bytes as "first-end first-end ..", empty where none."""
    docs = documents(spark, sf_dir)
    out = score(docs, fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s[0], s[1])), " "))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose score stays under THRESHOLD, with all their columns; rows of null or empty text stay with the clean."""
    bounded_batches(spark)
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches_in):
        for batch in batches_in:
            got = [score_texts([t.decode() for t in texts], shared.value)[0] for _, _, texts in text_runs(batch)]
            yield batch.filter(pa.array(np.concatenate(got) < THRESHOLD)) if got else batch

    return docs.mapInArrow(run, docs.schema)
