"""Ranked search, the Merkle manifest and the quality classifier against brute force."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import lexical, merkle, quality
from pulsegrid.llm.batches import lower_ascii

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score STRING, rank STRING, term STRING, shard STRING, leaf STRING"
CLASH = ("clash",) * 5


def table(spark, rows):
    full = [(i, t, lang, source, None if t is None else len(t), *CLASH) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward():
    """Nulls, empties, ties, repeated rows and ids, odd characters, a very long text."""
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "gamma9", "éa", "日本", "x_y", "delta", "the", "THE", "of"]
    rows = [
        (None, "alpha beta", "en", "s"),
        (1, None, None, None),
        (2, "", "", ""),
        (3, " .,;_\t", "en", "s"),
        (4, "alpha beta", "en", None),
        (5, "alpha beta", "en", "s"),
        (5, "alpha beta", "en", "s"),
        (6, "ALPHA gamma9 the the the", "fr", "s"),
        (6, "gamma9", "fr", "s"),
        (7, "the " * 30_000 + "alpha", None, "s"),
        (8, "y" * 70_000, "日本", "s"),
    ]
    return rows + [(100 + i, " ".join(rng.choice(words, int(rng.integers(1, 30)))), ["en", "fr"][i % 3 == 0], f"s{i}") for i in range(90)]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, best):
    counts = [(doc_id, Counter(terms(t))) for doc_id, t, *_ in docs if terms(t)]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        asked = [(t, math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t in set(terms(text)) if t in df]
        scores = []
        for doc_id, c in counts:
            m = 100 - 50 + (50 * c.total() * n) // total
            s = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in asked if t in c)
            if s > 0:
                scores.append((-s, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:best])]
    return sorted(out, key=repr)


ITEMS = [(1, "alpha of the"), (2, None), (3, "?!"), (4, "nowhere"), (5, "Éa éa 日本 gamma9"), (1, "delta"), (None, "beta x y"), (9, "the")]


@pytest.mark.parametrize("best, postings", [(50, lexical.SHARD_POSTINGS), (3, 20)])
def test_ranked_search(spark, best, postings):
    items = spark.createDataFrame([(*x, "clash", "clash") for x in ITEMS], "item_id BIGINT, text STRING, term STRING, item STRING")
    index = lexical.write_index(table(spark, awkward()).repartition(3), postings=postings)
    got = [tuple(r) for r in lexical.search(index, items, best=best).collect()]
    assert sorted(got, key=repr) == ranked(awkward(), ITEMS, best)


def test_ranked_search_stops_early():
    """Strata that cannot reach the best found are not looked at, and the answer is the same."""
    rng = np.random.default_rng(7)
    docs = [(i, " ".join(["rare"] * (i < 40) + ["common"] * int(rng.integers(1, 3)) + ["filler"] * int(rng.integers(0, 400)))) for i in range(3000)]
    sizes = [len(terms(t)) for _, t in docs]
    shard = lexical._Shard()
    for (doc_id, text), n in zip(docs, sizes, strict=True):
        shard.add(doc_id, lexical.normaliser(n, len(docs), sum(sizes)), Counter(lexical.terms_of(text.encode())))
    head, *rest = shard.batches(0, lexical.pa.int64())
    posted = {r["term"]: r for b in rest for r in b.select(["term", "docs", "tfs"]).to_pylist()}
    lists = [tuple(np.frombuffer(posted[t][c], np.int32) for c in ("docs", "tfs")) for t in ("rare", "common")]
    strata = lexical.Strata(
        np.frombuffer(head.column("ms")[0].as_py(), np.int64), np.frombuffer(head.column("ranks")[0].as_py(), np.int32), lists
    )
    n = len(docs)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * len(x[0]) + 1))) for x in lists])
    places, scores = strata.best(np.array([0, 1]), weights, 10)
    ids = head.column("doc_ids")[0].as_py()
    got = sorted(((-s, ids[p]) for p, s in zip(places.tolist(), scores.tolist(), strict=True)))
    want = [(-s, d) for _, _, d, s in sorted(ranked(docs, [(1, "rare common")], 10), key=lambda x: x[1])]
    assert got == want
    bounds = (weights[:, None] * strata.top).sum(0)
    assert (bounds < scores.min()).sum() > 0


def test_ranked_search_of_nothing(spark):
    none = table(spark, awkward()).limit(0)
    items = spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING")
    for docs in (none, table(spark, [(1, None, None, None), (2, "..", "en", "s")])):
        index = lexical.write_index(docs)
        assert lexical.search(index, items).count() == 0
    index = lexical.write_index(table(spark, awkward()))
    assert lexical.search(index, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(index, items.limit(0)).count() == 0
    named = table(spark, awkward()).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = lexical.search(lexical.write_index(named), items)
    assert got.schema["doc_id"].dataType.simpleString() == "string" and got.count() == len(ranked(awkward(), ITEMS, 50))


def field(value):
    if value is None:
        return "-"
    raw = str(value).encode()
    return f"{len(raw)}:" + str(value)


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def manifest(rows):
    """Leaves, roots, proofs and folded roots, leaf by leaf."""
    made = []
    for doc_id, text, lang, source in rows:
        n = None if text is None else len(text)
        leaf = h(*map(field, (doc_id, source, lang, n)), field(text))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        low = text if text is None or not hit else text.translate(LOWER)
        claim = h(*map(field, (doc_id, source, lang, n)), field(low)) if hit else ""
        made.append((lang is not None, (lang or "").encode(), doc_id is not None, doc_id or 0, leaf, claim, doc_id))
    made.sort()
    trees = {}
    for x in made:
        trees.setdefault(x[:2], []).append(x)
    built = {k: tree_levels([x[4] for x in v]) for k, v in trees.items()}
    top = tree_levels([built[k][-1][0] for k in trees])
    out = []
    for place, (k, v) in enumerate(trees.items()):
        for i, x in enumerate(v):
            value, proof = x[5] or x[4], []
            for levels, at in ((built[k], i), (top, place)):
                for level in levels[:-1]:
                    first = at - at % 8
                    run = level[first : first + 8]
                    proof += [d for j, d in enumerate(run) if first + j != at]
                    value = h(*(value if first + j == at else d for j, d in enumerate(run)))
                    at //= 8
            out.append((x[6], x[4], built[k][-1][0], top[-1][0], h(*proof), value, value == top[-1][0]))
    return sorted(out, key=repr)


def proved(docs, levels):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    made = merkle.write_manifest(docs, claims={"text": lower_ascii(F.col("text"))}, claimed=crc % 3 == 0, levels=levels)
    rows = merkle.proofs(made).withColumn("proof", F.sha2(F.lower(F.hex("proof")), 256))
    return sorted((tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, levels):
    assert proved(table(spark, awkward()).repartition(4), levels) == manifest(awkward())


def test_manifest_of_many_trees(spark):
    rows = [(i, f"Text {i}", f"l{i % 70}" if i % 70 else None, "s") for i in range(600)]
    assert proved(table(spark, rows), 1) == manifest(rows)


def test_manifest_of_little(spark):
    assert proved(table(spark, awkward()).limit(0), 4) == []
    for rows in ([(3, "One", "en", "s")], [(i, None, None, None) for i in range(9)]):
        assert proved(table(spark, rows), 4) == manifest(rows)


def test_multiproof_is_least():
    """No node that the leaves give themselves, and enough to reach the root."""
    rng = np.random.default_rng(2)
    for total in (1, 2, 8, 9, 64, 65, 700):
        leaves = [h(str(i)) for i in range(total)]
        levels = tree_levels(leaves)
        for some in (1, 3, min(total, 40)):
            places = rng.choice(total, min(some, total), replace=False).tolist()
            wanted = merkle.missing(places, total)
            assert len(set(wanted)) == len(wanted)
            known = {(0, i): leaves[i] for i in places} | {(level, i): levels[level][i] for level, i in wanted}
            assert merkle.derive(known, total)[merkle.height(total), 0] == levels[-1][0]
            for gone in wanted:
                less = {k: v for k, v in known.items() if k != gone}
                assert (merkle.height(total), 0) not in merkle.derive(less, total)


JUNK = ["buy $$$ now %%% ", "a | b | c | ", "again again again "]


def labelled():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(240):
        prose = " ".join(rng.choice(words, int(rng.integers(20, 80)))) + "."
        rows.append((i, JUNK[i % 3] * 10 + prose if i % 4 == 0 else prose, int(i % 4 != 0)))
    return rows


def test_quality_features():
    texts = ["One one, two two  two", "", "One one, two two  two", "\xe9" * 100 + " !!", "  "]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    found = quality.features(np.frombuffer(b"".join(data), np.uint8), offsets)
    cut = [(found.slots[a:b].tolist(), found.values[a:b].round(9).tolist()) for a, b in zip(found.cuts[:-1], found.cuts[1:], strict=True)]
    assert cut[0] == cut[2] and cut[1] == cut[4] == ([], [])
    # One one , two (3 times); 5 pairs, one twice... of equal words two next to each other, one two apart
    assert sum(round(v * v * (6 + 5 + 3), 6) for v in cut[0][1]) == 14
    assert all(abs(sum(v * v for v in values) - 1) < 1e-9 for _, values in cut if values)
    alone = quality.features(np.frombuffer(data[3], np.uint8), np.array([0, len(data[3])]))
    assert alone.slots.tolist() == cut[3][0]


def test_quality_learns_and_holds_out(spark):
    rows = labelled()
    docs = table(spark, [(i, t, "en", "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (1, 7)], "doc_id BIGINT, quality INT")
    model = quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40
    assert all((scores[i] >= quality.PREDICT) == bool(q) for i, _, q in rows if i in held)
    # labels of held-out rows change nothing
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, turned)
    assert again.bias == model.bias and (again.weights == model.weights).all()


def test_quality_of_awkward_rows(spark):
    rows = labelled()
    docs = table(spark, [(i, t, "en", "s") for i, t, _ in rows])
    model = quality.fit(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id BIGINT, quality INT"))
    got = quality.score(table(spark, awkward()).repartition(3), model)
    assert got.columns == ["doc_id", "score"]
    scores = {(r.doc_id, r.score) for r in got.collect()}
    assert all(0 <= s <= 1 for _, s in scores)
    assert len([1 for d, _ in scores if d == 5]) == 1 and got.count() == len(awkward())
    bias = 1 / (1 + math.exp(-model.bias))
    assert {round(s, 12) for d, s in scores if d in (1, 2)} == {round(bias, 12)}
    assert quality.score(docs.limit(0), model).count() == 0
    # one class only, no labels
    ones = spark.createDataFrame([(i, 1) for i, *_ in rows], "doc_id BIGINT, quality INT")
    assert quality.score(docs, quality.fit(docs, ones)).where("score < 0.9").count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, ones.limit(0))).collect()} == {0.5}
    assert quality.fit(docs.limit(0), ones).bias == 0


def test_learning_follows_the_leader():
    """One weight at a time, by the textbook form of the update."""
    state = quality.empty_state()
    rng = np.random.default_rng(1)
    z, n = Counter(), Counter()
    for _ in range(50):
        slots = np.unique(rng.integers(0, 20, 6))
        values = rng.random(len(slots))
        label, weight = int(rng.integers(0, 2)), 1.5
        line = {**dict(zip(slots.tolist(), values.tolist(), strict=True)), 1 << quality.BITS: 1.0}

        def leader(i):
            if abs(z[i]) <= quality.L1:
                return 0.0
            return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

        w = {i: leader(i) for i in line}
        p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in line.items())))
        for i, x in line.items():
            g = weight * (p - label) * x
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
            n[i] += g * g
        quality.learn(state, slots, values, label, weight)
    assert all(abs(state.z[i] - z[i]) < 1e-9 and abs(state.n[i] - n[i]) < 1e-9 for i in z)
