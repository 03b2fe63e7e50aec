"""Toxic spans and document scores from a linear-chain conditional random field.

Labels come per document; a greedy cover of the toxic training documents by words and
word beginnings that clean ones lack turns them into token labels. The field has two
states, weights per lexicon entry at a token and beside it, and transitions. Marginals of
the forward-backward pass give spans; their largest value and sum give a document's score
through a logistic curve fitted to the document labels.
"""

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.batches import Batches, documents, map_batches
from pulsegrid.session import written

#: Bounds of what is learned from: documents a class, entries looked at, entries of the
#: lexicon, token windows. Chosen by hash, so alike on every run.
TRAIN_DOCS, CANDIDATES, LEXICON, WINDOWS = 20_000, 200_000, 2_000, 30_000
#: Toxic documents that an entry must explain, beyond those explained already; clean
#: documents (of a sample as large as the toxic one) that weigh as one toxic document less;
#: how much more frequent it must be in toxic ones.
LEAST_DOCS, CLEAN_WEIGHT, LEAST_ODDS = 4, 4.0, 5
#: Share of the toxic documents from which on a word is taken for itself.
COMMON = 0.02
BEGINNINGS = (9, 8, 7, 6, 5, 4)
REACH = 8
MEMO = 100_000
PREDICT = 0.7

WORD = re.compile(r"[^\W\d_]+")


def entries_of(word: str) -> list[str]:
    """What a word can be known by: itself, then its beginnings, longest first."""
    word = word.lower()
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


class Model(NamedTuple):
    """All that scoring needs; a few kilobytes."""

    codes: dict[str, int]
    at: np.ndarray
    beside: np.ndarray
    transition: np.ndarray
    bias: float
    curve: tuple[float, float, float]


class Codes(dict):
    """Word to its lexicon code, 0 for none; remembers what it has seen."""

    def __init__(self, codes: dict[str, int]):
        super().__init__()
        self.codes = codes

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        code = next((self.codes[e] for e in entries_of(word) if e in self.codes), 0)
        self[word] = code
        return code


def training_sample(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text, toxic of at most ``bound`` labelled documents a class.

    Rows whose crc32(doc_id) leaves 1 modulo 3 are held out. The ids of the sample are
    bounded, so they are broadcast and no text is shuffled.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    some = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (0, 1)
    ]
    return docs.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("doc_id", "text", "toxic")


def _counts(sample: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """entry, n: in how many documents of the sample an entry occurs."""

    def task(batches: Batches) -> Batches:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                entries = {e for word in {w.lower() for w in WORD.findall(text)} for e in entries_of(word)}
                counts.update(entries if among is None else entries & among)
            if len(counts) > MEMO:
                yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["entry", "n"])
                counts.clear()
        yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["entry", "n"])

    return map_batches(sample, task, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _lexicon(sample: DataFrame) -> dict[str, int]:
    """Entries that explain the toxic documents, each with a code from 1 on."""
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    rows = (
        _counts(toxic, None)
        .where(F.col("n") >= LEAST_DOCS)
        .orderBy(F.desc("n"), "entry")
        .limit(CANDIDATES)
        .collect()
    )
    in_toxic = {row["entry"]: row["n"] for row in rows}
    in_clean = {row["entry"]: row["n"] for row in _counts(clean, frozenset(in_toxic)).collect()}
    share = max(1, toxic.count()) / max(1, clean.count())
    gain = {e: n - CLEAN_WEIGHT * share * in_clean.get(e, 0) for e, n in in_toxic.items()}
    good = {e for e, n in gain.items() if n >= LEAST_DOCS and in_clean.get(e, 0) * share * LEAST_ODDS <= in_toxic[e]}

    def task(batches: Batches) -> Batches:
        for batch in batches:
            lists = [
                sorted({e for w in {w.lower() for w in WORD.findall(t)} for e in entries_of(w)} & good)
                for t in batch.column("text").to_pylist()
            ]
            yield pa.record_batch([pa.array(lists, pa.list_(pa.string()))], ["entries"])

    # at most TRAIN_DOCS rows of entries that passed the test above
    open_docs = [row[0] for row in map_batches(toxic, task, "entries array<string>").where(F.size("entries") > 0).collect()]
    chosen: dict[str, int] = {}
    while open_docs and len(chosen) < LEXICON:
        covers = Counter(e for entries in open_docs for e in entries)
        penalty = {e: CLEAN_WEIGHT * share * in_clean.get(e, 0) for e in covers}
        # the more special of two that cover the same: whole words, then long beginnings
        best = max(covers, key=lambda e: (covers[e] - penalty[e], not e.endswith("-"), len(e), e))
        if covers[best] - penalty[best] < LEAST_DOCS:
            break
        chosen[best] = len(chosen) + 1
        open_docs = [entries for entries in open_docs if best not in entries]
    return _frequent_words(toxic, chosen, {e: n for e, n in gain.items() if e in good}, sum_toxic=toxic.count())


def _frequent_words(toxic: DataFrame, chosen: dict[str, int], gain: dict[str, float], sum_toxic: int) -> dict[str, int]:
    """Further entries that a large share of the toxic documents has, in many different
    surroundings: copies of one document repeat their words in the same ones."""
    least = max(LEAST_DOCS, sum_toxic * COMMON)
    wanted = frozenset(e for e, n in gain.items() if n >= least)
    codes = Codes(chosen)

    def task(batches: Batches) -> Batches:
        for batch in batches:
            found = {
                (line[i], line[i - 1] if i else "", line[i + 1] if i + 1 < len(line) else "")
                for text in batch.column("text").to_pylist()
                for line in [[w.lower() for w in WORD.findall(text)]]
                for i in range(len(line))
                if not codes[line[i]] and not wanted.isdisjoint(entries_of(line[i]))
            }
            yield pa.record_batch([pa.array(x, pa.string()) for x in (zip(*found) if found else ([], [], []))], ["word", "before", "after"])

    counts = (
        map_batches(toxic, task, "word string, before string, after string")
        .distinct()
        .groupBy("word")
        .count()
        .orderBy(F.desc("count"), "word")
        .limit(CANDIDATES)
        .collect()
    )
    open_words = {row["word"]: row["count"] for row in counts}
    chosen = dict(chosen)
    while open_words and len(chosen) < LEXICON:
        support: Counter[str] = Counter()
        for word, n in open_words.items():
            support.update({e: n for e in entries_of(word) if e in wanted})
        best = max(support, key=lambda e: (support[e], not e.endswith("-"), len(e), e))
        if support[best] < 2 * least:
            break
        chosen[best] = len(chosen) + 1
        open_words = {word: n for word, n in open_words.items() if best not in entries_of(word)}
    return chosen


def _windows(sample: DataFrame, codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Token windows for training: lexicon codes (-1 beyond the text) and token labels."""
    width = 2 * REACH + 1

    def task(batches: Batches) -> Batches:
        seen = Codes(codes)
        for batch in batches:
            lists: list[list[int]] = []
            labels: list[int] = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                line = [seen[w] for w in WORD.findall(text)]
                hits = [i for i, c in enumerate(line) if c]
                for i in [*hits[:3], len(line) // 2][: len(line)]:
                    lists.append([line[j] if 0 <= j < len(line) else -1 for j in range(i - REACH, i + REACH + 1)])
                    labels.append(toxic)
            yield pa.record_batch([pa.array(lists, pa.list_(pa.int32())), pa.array(labels, pa.int32())], ["line", "toxic"])

    rows = (
        map_batches(sample, task, "line array<int>, toxic int")
        .orderBy(F.xxhash64("line", "toxic"))
        .limit(WINDOWS)
        .collect()
    )
    lines = np.array([row["line"] for row in rows], np.int64).reshape(-1, width)
    toxic = np.array([row["toxic"] for row in rows], np.int64)
    return lines, np.where(lines > 0, toxic[:, None], 0)


def _scores(lines: np.ndarray, at: np.ndarray, beside: np.ndarray, bias: float) -> np.ndarray:
    """Score of the toxic state at each token (the other state has 0)."""
    code = np.maximum(lines, 0)
    near = np.zeros(code.shape)
    near[:, 1:] += beside[code[:, :-1]]
    near[:, :-1] += beside[code[:, 1:]]
    return bias + at[code] + near


def marginals(emit: np.ndarray, transition: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over rows of toxic-state scores: the probability of the toxic state
    at each token, and the expected number of transitions a row. ``inside`` masks tokens."""
    rows, long = emit.shape
    step = np.exp(transition)
    weight = np.stack([np.ones_like(emit), np.exp(emit)], 2)
    weight[~inside] = 1.0
    forward = np.empty((rows, long, 2))
    backward = np.ones((rows, long, 2))
    for t in range(long):
        now = weight[:, t] if t == 0 else np.where(
            inside[:, t - 1, None], (forward[:, t - 1] @ step) * weight[:, t], weight[:, t]
        )
        forward[:, t] = now / now.sum(1, keepdims=True)
    for t in range(long - 2, -1, -1):
        now = (weight[:, t + 1] * backward[:, t + 1]) @ step.T
        now = np.where(inside[:, t + 1, None], now, 1.0)
        backward[:, t] = now / now.sum(1, keepdims=True)
    both = forward * backward
    both /= both.sum(2, keepdims=True)
    pair = forward[:, :-1, :, None] * step * (weight[:, 1:] * backward[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    pair *= (inside[:, 1:] & inside[:, :-1])[:, :, None, None]
    return both[:, :, 1], pair.sum((0, 1))


def fit_field(lines: np.ndarray, labels: np.ndarray, size: int, rounds: int = 80) -> tuple:
    """Weights by gradient ascent (Adam) on the penalized conditional likelihood."""
    at, beside, bias = np.zeros(size), np.zeros(size), np.array([-4.0])
    transition = np.zeros((2, 2))
    inside = lines >= 0
    code = np.maximum(lines, 0)
    moved = (labels[:, :-1] * 2 + labels[:, 1:])[inside[:, :-1] & inside[:, 1:]]
    seen = np.bincount(moved, minlength=4).reshape(2, 2)
    parameters = [at, beside, bias, transition]
    first = [np.zeros_like(x) for x in parameters]
    second = [np.zeros_like(x) for x in parameters]
    for k in range(1, rounds + 1):
        expected, pairs = marginals(_scores(lines, at, beside, bias[0]), transition, inside)
        rest = np.where(inside, labels - expected, 0.0)
        slope_beside = np.bincount(code[:, :-1].ravel(), rest[:, 1:].ravel(), size)
        slope_beside += np.bincount(code[:, 1:].ravel(), rest[:, :-1].ravel(), size)
        slopes = [np.bincount(code.ravel(), rest.ravel(), size), slope_beside, np.array([rest.sum()]), seen - pairs]
        slopes[0][0] = slopes[1][0] = 0.0
        for x, m, v, g in zip(parameters, first, second, slopes, strict=True):
            g = g / len(lines) - 1e-4 * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return at, beside, transition, float(bias[0])


def _scored_tokens(model: Model, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token places near lexicon words and their marginals. Tokens further away than REACH
    from any have all the same small marginal and are left out; a stretch of tokens between
    two of these neighbourhoods carries over only what the chain has forgotten by then."""
    hits = np.flatnonzero(line)
    if not len(hits):
        return hits, np.zeros(0)
    near = np.unique(np.clip(hits[:, None] + np.arange(-REACH, REACH + 1), 0, len(line) - 1))
    parts = np.split(near, np.flatnonzero(np.diff(near) > 1) + 1)
    values = []
    for part in parts:
        codes = line[part][None, :]
        values.append(marginals(_scores(codes, model.at, model.beside, model.bias), model.transition, codes >= 0)[0][0])
    return near, np.concatenate(values)


def _aggregate(values: np.ndarray) -> tuple[float, float]:
    """Largest marginal as log odds, and the logarithm of the expected number of toxic tokens."""
    if not len(values):
        return 0.0, 0.0
    top = min(max(float(values.max()), 1e-6), 1 - 1e-6)
    return max(0.0, math.log(top / (1 - top)) + 4), math.log1p(float(values.sum()))


def _curve(points: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve through (1, largest, sum) by damped Newton steps."""
    x = np.column_stack([np.ones(len(points)), points])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1, 0.1])
        w += np.clip(np.linalg.solve(hessian, x.T @ (labels - p) - np.array([0, 0.1, 0.1]) * w), -4, 4)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    """Learn lexicon, field and curve from a bounded sample of the labelled documents.

    Without labels of both classes all texts get the share of toxic labels (or 0) as score.
    """
    sample = written(training_sample(documents(docs), labels, bound), "toxic-sample")
    sizes = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    if not sizes.get(1) or not sizes.get(0):
        share = min(max(sizes.get(1, 0) / total if total else 0.0, 1e-6), 1 - 1e-6)
        return Model({}, np.zeros(1), np.zeros(1), np.zeros((2, 2)), -4.0, (math.log(share / (1 - share)), 0.0, 0.0))
    codes = _lexicon(sample)
    lines, tags = _windows(sample, codes)
    at, beside, transition, bias = fit_field(lines, tags, len(codes) + 1)
    model = Model(codes, at, beside, transition, bias, (0.0, 0.0, 0.0))

    def task(batches: Batches) -> Batches:
        seen = Codes(codes)
        for batch in batches:
            points = [
                _aggregate(_scored_tokens(model, np.array([seen[w] for w in WORD.findall(t)], np.int64))[1])
                for t in batch.column("text").to_pylist()
            ]
            yield pa.record_batch(
                [pa.array([p[0] for p in points], pa.float64()), pa.array([p[1] for p in points], pa.float64()), batch.column("toxic")],
                ["largest", "total", "toxic"],
            )

    rows = map_batches(sample, task, "largest double, total double, toxic int").collect()  # a row a sampled document
    points = np.array([(row[0], row[1]) for row in rows])
    return model._replace(curve=_curve(points, np.array([row[2] for row in rows], float)))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's score and toxic spans: doc_id, the columns of ``keep`` ("text" among
    them stands for the text itself), score (0 to 1), spans (array of start, end in code
    points, and p).

    The whole text counts; a null or empty one has no spans and the score of a text
    without offending words. Null ids and repeated rows are kept as they come; other
    columns of ``docs`` are not looked at. No shuffle.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(c for c in keep if c != "text")
    )
    b0, b1, b2 = model.curve

    def task(batches: Batches) -> Batches:
        seen = Codes(model.codes)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                line = np.fromiter(map(seen.__getitem__, WORD.findall(text)), np.int64)
                places, values = _scored_tokens(model, line)
                largest, total = _aggregate(values)
                scores.append(1 / (1 + math.exp(-min(max(b0 + b1 * largest + b2 * total, -30), 30))))
                spans.append(_spans(text, dict(zip(places.tolist(), values.tolist(), strict=True))) if len(places) else [])
            arrays = [batch.column(c) for c in ("doc_id", *keep)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.record_batch([*arrays, pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", *keep, "score", "spans"])

    kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return map_batches(source, task, f"{kept}, score double, spans array<struct<start:int,end:int,p:double>>")


def _spans(text: str, values: dict[int, float]) -> list[dict]:
    """Runs of words more likely toxic than not."""
    out: list[dict] = []
    last = -2
    for i, match in enumerate(WORD.finditer(text)):
        p = values.get(i, 0.0)
        if p < 0.5:
            continue
        if i == last + 1:
            out[-1]["end"] = match.end()
            out[-1]["p"] = max(out[-1]["p"], p)
        else:
            out.append({"start": match.start(), "end": match.end(), "p": p})
        last = i
    return out
