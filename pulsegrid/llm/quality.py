"""Text quality by logistic regression over hashed word n-grams.

A text's features are its words and pairs of neighbouring words, hashed into a fixed number
of slots. Weights follow the regularised leader (FTRL-proximal) over a bounded sample of
labelled texts: parts of the sample are walked through side by side from a common state,
whose accumulators are then averaged, round after round. A score is one sparse dot product.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.batches import Batches, map_batches
from pulsegrid.session import written

#: Labelled documents a class that are learned from, at most, chosen by hash.
TRAIN_DOCS = 10_000
#: Slots are 2 to this power; words of an n-gram, at most.
BITS, WORDS = 18, 2
#: How far back a word is held against the ones before it.
AGAIN = 3
#: Parts the sample is dealt to and walks through it.
PARTS, ROUNDS = 8, 4
#: Step size, its smoothing, and the weights of the two penalties.
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.2, 0.0
PREDICT = 0.7
LONG = 64

_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _kinds() -> np.ndarray:
    """0 for blanks, 1 for letters and figures (all of non-ASCII too), 2 for other marks."""
    kinds = np.full(256, 2, np.uint8)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        kinds[low : high + 1] = 1
    kinds[[0x20, *range(0x09, 0x0E)]] = 0
    return kinds


KINDS = _kinds()


class Features(NamedTuple):
    """Slots of several texts, those of a text together, and their values."""

    slots: np.ndarray
    values: np.ndarray
    #: Where each text's slots begin, and the end of the last.
    cuts: np.ndarray


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: eight bytes a step, all words side by side; those of more
    than LONG bytes one by one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    value = (ends - starts).astype(np.uint64) * _GOLD
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        value[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    live = np.flatnonzero(ends - starts <= LONG)
    at = starts[live].astype(np.int64)
    while len(live):
        left = np.minimum(ends[live] - at, 8)
        chunk = np.zeros(len(live), np.uint64)
        for k in range(8):
            byte = padded[at + k].astype(np.uint64)
            chunk |= np.where(k < left, byte, np.uint64(0)) << np.uint64(8 * k)
        value[live] = _mixed(value[live] ^ chunk)
        at = at + 8
        more = at < ends[live]
        live, at = live[more], at[more]
    return value


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * _MIX
    return (value ^ (value >> np.uint64(27))) * _GOLD


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    """Features of the texts that ``offsets`` cut ``data`` (UTF-8 bytes) into.

    Words are runs of letters and figures, or of other marks; upper and lower case are
    told apart. Beside single words and n-grams of words, "the same word as so many words
    before" is a feature, whatever the word. A value is the square root of the n-gram's share of the text, so that a
    text's values have length 1.
    """
    kinds = KINDS[data]
    change = np.ones(len(data), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(data))
    solid = kinds[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    text = np.searchsorted(offsets, starts, side="right") - 1
    words = _word_hashes(data, starts, ends)
    grams, owners = [words], [text]
    run = words
    for n in range(1, WORDS):
        run = _mixed(run[:-1] * _GOLD + words[n:])
        whole = text[: len(run)] == text[n:]
        grams.append(run[whole])
        owners.append(text[: len(run)][whole])
    for back in range(1, AGAIN + 1):
        same = (words[back:] == words[:-back]) & (text[back:] == text[: len(text) - back])
        owners.append(text[back:][same])
        grams.append(np.full(int(same.sum()), _mixed(np.uint64([back]))[0]))
    slot = (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)
    both, often = np.unique((np.concatenate(owners).astype(np.int64) << BITS) | slot, return_counts=True)
    owner = both >> BITS
    cuts = np.searchsorted(owner, np.arange(len(offsets)))
    total = np.bincount(owner, often, len(offsets))
    return Features(both & ((1 << BITS) - 1), np.sqrt(often / total[owner]), cuts)


def _of_column(column: pa.Array) -> Features:
    """Features of a binary column without nulls."""
    column = pa.concat_arrays([column])  # offsets from 0 on
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1)[: len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return features(data, offsets - offsets[0])


class State(NamedTuple):
    """What FTRL-proximal keeps of a weight: its shifted sum of slopes, and that of their
    squares. Index 2 ** BITS is the bias."""

    z: np.ndarray
    n: np.ndarray

    def weights(self) -> np.ndarray:
        out = -(self.z - np.sign(self.z) * L1) / ((BETA + np.sqrt(self.n)) / ALPHA + L2)
        return np.where(np.abs(self.z) <= L1, 0.0, out)


def empty_state() -> State:
    return State(np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1))


def learn(state: State, slots: np.ndarray, values: np.ndarray, label: int, weight: float) -> None:
    """One step: the leader's weights at the slots, their slope, the accumulators."""
    slots, values = np.append(slots, 1 << BITS), np.append(values, 1.0)
    z, n = state.z[slots], state.n[slots]
    root = np.sqrt(n)
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + root) / ALPHA + L2))
    p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
    slope = weight * (p - label) * values
    state.z[slots] = z + slope - (np.sqrt(n + slope * slope) - root) / ALPHA * w
    state.n[slots] = n + slope * slope


class Model(NamedTuple):
    """Weights by slot and the bias; score = logistic(bias + dot product)."""

    weights: np.ndarray
    bias: float


def training_sample(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """text, quality of at most ``bound`` labelled documents a class.

    Rows whose crc32(doc_id) leaves 2 modulo 4 are held out. Of repeated labels of one id
    the larger counts. The ids of the sample are bounded, so they are broadcast and no text
    is shuffled.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
    )
    some = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (0, 1)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    """Learn from a bounded sample of the labelled documents.

    Each part of the sample starts from the common state; the next one is, slot by slot, the
    mean over the parts that have the slot. Both classes weigh alike. Without labels of both classes all texts get the
    share of label 1 (0.5 without any label) as score.
    """
    sample = training_sample(docs, labels, bound)

    def hashed(batches: Batches) -> Batches:
        for batch in batches:
            found = _of_column(batch.column("text"))
            cuts = pa.array(found.cuts, pa.int32())
            slots, values = (pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (found.slots.astype(np.int32), found.values.astype(np.float32)))
            yield pa.record_batch([batch.column("doc_id"), slots, values, batch.column("label")], ["doc_id", "slots", "values", "label"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    lines = written(map_batches(sample, hashed, f"doc_id {kind}, slots array<int>, values array<float>, label int"), "quality-sample")
    sizes = {row["label"]: row["count"] for row in lines.groupBy("label").count().collect()}
    total = sum(sizes.values())
    if not sizes.get(0) or not sizes.get(1):
        share = min(max(sizes.get(1, 0) / total if total else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    weight = {y: total / (2 * n) for y, n in sizes.items()}
    state = empty_state()
    for _ in range(ROUNDS):
        state = _round(lines, state, weight)
    weights = state.weights()
    return Model(weights[:-1], float(weights[-1]))


def _round(lines: DataFrame, state: State, weight: dict[int, float]) -> State:
    """The mean of the states that the parts reach from ``state``."""

    def task(batches: Batches) -> Batches:
        own = State(state.z.copy(), state.n.copy())
        for batch in batches:
            slots, values = batch.column("slots"), batch.column("values")
            cuts = np.concatenate([[0], np.cumsum(slots.value_lengths().to_numpy())])
            flat, shares = slots.flatten().to_numpy(), values.flatten().to_numpy().astype(np.float64)
            for k, label in enumerate(batch.column("label").to_pylist()):
                part = slice(cuts[k], cuts[k + 1])
                learn(own, flat[part], shares[part], label, weight[label])
        at = np.flatnonzero(own.n != state.n)
        yield pa.record_batch(
            [pa.array(at, pa.int64()), pa.array((own.z - state.z)[at]), pa.array((own.n - state.n)[at])], ["slot", "z", "n"]
        )

    order = F.xxhash64("doc_id", "slots")
    moved = map_batches(lines.repartition(PARTS, order).sortWithinPartitions(order), task, "slot long, z double, n double")
    # a row a slot, 2 ** BITS at most; summed in a fixed order, so that every run gives the same weights
    mean = "aggregate(sort_array(collect_list({0})), 0D, (a, x) -> a + x) / count(1)"
    means = moved.groupBy("slot").agg(*(F.expr(mean.format(x)).alias(x) for x in ("z", "n"))).toArrow()
    at = means.column("slot").to_numpy()
    out = State(state.z.copy(), state.n.copy())
    out.z[at] += means.column("z").to_numpy()
    out.n[at] += means.column("n").to_numpy()
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every document, in one pass without a shuffle.

    The whole text counts; a null or empty one has the score of the bias. Null ids and
    repeated rows are kept as they come; other columns of ``docs`` are not looked at.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    used = np.flatnonzero(model.weights)
    slots, weights, bias = used.astype(np.int32), model.weights[used], model.bias

    def task(batches: Batches) -> Batches:
        full = np.zeros(1 << BITS)
        full[slots] = weights
        for batch in batches:
            found = _of_column(batch.column("text"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(found.cuts))
            total = bias + np.bincount(owner, full[found.slots] * found.values, batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], ["doc_id", "score"])

    return map_batches(source, task, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
