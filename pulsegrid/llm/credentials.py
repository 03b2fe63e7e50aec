"""Secrets in texts: patterns, and formats learned from what the patterns find.

The labelled credentials are the matches of three base patterns. Per kind their prefix tree
is folded into a probabilistic automaton by merging states that go on and end alike within a
Hoeffding bound and have like lengths ahead. Every run of credential characters, base
matches included, is then scored by how much likelier such an automaton makes its format
than one of ordinary runs.
"""

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.batches import Batches, documents, map_batches
from pulsegrid.session import written

ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
#: Base kinds in order, and the kind of what the automata add.
KINDS, LEARNED = ("assign", "access", "hex"), "format"
#: Ordinary runs that are learned from only if no document has a better one.
SPARE = "spare"
#: A candidate: a run of credential characters as long as the shortest secret the patterns take.
RUN = re.compile("[A-Za-z0-9+/_=-]{12,}")
ORDINARY = re.compile("[A-Za-z0-9+/_=-]{8,}")

#: Distinct credentials a kind, and ordinary runs, that are learned from; chosen by hash.
SAMPLE = 600
#: Longer ones are scored but not learned from.
LONGEST = 200
#: Confidence of the merge test on moves and ends, and of the stricter one on lengths ahead.
ALPHA, ALPHA_LENGTH = 0.05, 0.8
#: Bits by which a credential's format must be likelier than an ordinary run's.
BITS = 20.0
#: Scores by shape that a task remembers.
MEMO = 100_000

SPAN = "struct<kind:string,start:int,end:int,secret:string,score:double>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end (code points, end exclusive) and secret part of the base matches,
    by start, then kind; leftmost non-overlapping per kind, failing ones dropped."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def shape(text: str) -> str:
    """The format of a run: figures, hexadecimal and other letters by case, marks as they are."""
    return text.translate(_SHAPES)


_SHAPES = {ord(c): s for s, cs in (("9", "0123456789"), ("h", "abcdef"), ("a", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("A", "GHIJKLMNOPQRSTUVWXYZ")) for c in cs}
SYMBOLS = "9haHA+/_.=-"


class State:
    """Counts of what passes, ends, moves on by symbol, and of the lengths still ahead."""

    __slots__ = ("ahead", "ends", "moves", "total")

    def __init__(self):
        self.moves: dict[str, list] = {}
        self.ahead = np.zeros(LONGEST + 1)
        self.total = self.ends = 0


def prefix_tree(shapes: list[str]) -> State:
    root = State()
    for text in shapes:
        state = root
        state.total += 1
        state.ahead[len(text)] += 1
        for done, symbol in enumerate(text, 1):
            move = state.moves.setdefault(symbol, [State(), 0])
            move[1] += 1
            state = move[0]
            state.total += 1
            state.ahead[len(text) - done] += 1
        state.ends += 1
    return root


def _apart(a: State, b: State) -> float | None:
    """The greatest difference of the two distributions of lengths ahead; None beyond what
    the numbers of their strings explain."""
    gap = float(np.abs(np.cumsum(a.ahead) / a.total - np.cumsum(b.ahead) / b.total).max())
    bound = math.sqrt(0.5 * math.log(2 / ALPHA_LENGTH)) * (1 / math.sqrt(a.total) + 1 / math.sqrt(b.total))
    return gap if gap <= bound else None


def _agree(a: State, b: State) -> bool:
    """Whether two states, and what follows them, have compatible frequencies."""
    width = math.sqrt(0.5 * math.log(2 / ALPHA))
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        bound = width * (1 / math.sqrt(a.total) + 1 / math.sqrt(b.total))
        if bound >= 1:  # nothing below can differ more than it may
            continue
        if abs(a.ends / a.total - b.ends / b.total) > bound:
            return False
        for symbol in a.moves.keys() | b.moves.keys():
            x, y = a.moves.get(symbol), b.moves.get(symbol)
            if abs((x[1] if x else 0) / a.total - (y[1] if y else 0) / b.total) > bound:
                return False
            if x and y and x[0] is not y[0]:
                stack.append((x[0], y[0]))
    return True


def _fold(into: State, other: State) -> None:
    """Add a subtree to a state and what follows it."""
    stack = [(into, other)]
    while stack:
        into, other = stack.pop()
        into.total += other.total
        into.ends += other.ends
        into.ahead += other.ahead
        for symbol, (target, n) in other.moves.items():
            if symbol in into.moves:
                into.moves[symbol][1] += n
                stack.append((into.moves[symbol][0], target))
            else:
                into.moves[symbol] = [target, n]


def automaton(shapes: list[str]) -> list[dict]:
    """The merged automaton as a table: per state log2 probabilities of its moves, with the
    target's number, of ending ("") and of what was never seen there ("?", Witten-Bell).

    A state is merged with the compatible one whose lengths ahead are most alike, so that
    strings of one length become a chain that knows its length. The last row is where what
    was never seen goes on: it knows how often symbols come, not where.
    """
    shapes = [s for s in shapes if len(s) <= LONGEST]
    root = prefix_tree(shapes)
    red = [root]
    done = {id(root)}
    while True:
        blue = [(move[1], symbol, move) for state in red for symbol, move in sorted(state.moves.items()) if id(move[0]) not in done]
        if not blue:
            break
        _, _, move = max(blue, key=lambda x: (x[0], x[1]))
        like = [(gap, i) for i, state in enumerate(red) if (gap := _apart(state, move[0])) is not None]
        for _, i in sorted(like):
            if _agree(red[i], move[0]):
                target, move[0] = move[0], red[i]
                _fold(red[i], target)
                break
        else:
            red.append(move[0])
            done.add(id(move[0]))
    number = {id(state): i for i, state in enumerate(red)}
    table = []
    for state in red:
        seen = len(state.moves) + (state.ends > 0)
        whole = state.total + seen
        row = {s: (math.log2(n / whole), number[id(t)]) for s, (t, n) in state.moves.items()}
        if state.ends:
            row[""] = (math.log2(state.ends / whole), 0)
        row["?"] = (math.log2(seen / whole) if seen else 0.0, len(red))
        table.append(row)
    whole = math.log2(sum(map(len, shapes)) + len(shapes) + 0.5 * (len(SYMBOLS) + 2))
    counts = {s: sum(x.count(s) for x in shapes) for s in SYMBOLS} | {"": len(shapes), "?": 0}
    table.append({s: (math.log2(n + 0.5) - whole, len(red)) for s, n in counts.items()})
    return table


def likelihood(table: list[dict], text: str) -> float:
    """log2 of the probability of a shape."""
    state, total, last = 0, 0.0, len(table) - 1
    for symbol in (*text, ""):
        row = table[state]
        move = row.get(symbol)
        if move is None:
            total += row["?"][0]
            if state == last:
                continue
            move = table[last].get(symbol) or table[last]["?"]
        total += move[0]
        state = move[1]
    return total


class Model(NamedTuple):
    kinds: dict[str, list[dict]]
    ordinary: list[dict]

    def score(self, run: str) -> float:
        """Bits by which the best credential automaton beats the ordinary one."""
        return self.of_shape(shape(run))

    def of_shape(self, text: str) -> float:
        if not self.kinds:
            return -math.inf
        return max(likelihood(t, text) for t in self.kinds.values()) - likelihood(self.ordinary, text)


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kind and text of what is learned from: secret parts of the base matches, and one
    ordinary run of each document (kind null; ``SPARE`` if not the first after a third of
    the text); written, so texts are read once."""

    def task(batches: Batches) -> Batches:
        for batch in batches:
            kinds, found = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                kinds += [k for k, *_ in base]
                found += [x for *_, x in base]
                clear = lambda m: not any(s < m.end() and m.start() < e for _, s, e, _ in base)  # noqa: B023, E731
                first, kind = ORDINARY.search(text, len(text) // 3), None
                if first is None or not clear(first):
                    first, kind = next(filter(clear, ORDINARY.finditer(text)), None), SPARE
                if first is not None:
                    kinds.append(kind)
                    found.append(first[0])
            yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(found, pa.string())], ["kind", "text"])

    rows = map_batches(documents(docs, id_col, text_col), task, "kind string, text string")
    return written(rows.where(F.length("text") <= LONGEST), "secrets")


def learn(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Automata from at most ``sample`` distinct labelled credentials a kind, and from as
    many ordinary runs. Without any of either nothing is added to the base spans."""

    def some(kind: str | None) -> list[str]:
        bounded = rows.where(F.col("kind").eqNullSafe(F.lit(kind))).select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(sample)
        return [shape(row[0]) for row in bounded.collect()]

    kinds = {k: some(k) for k in KINDS}
    ordinary = some(None) or some(SPARE)
    if not ordinary:
        return Model({}, [])
    return Model({k: automaton(x) for k, x in kinds.items() if x}, automaton(ordinary))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, base and learned spans (kind, start, end, score in bits; base ones with their
    secret) per document.

    Whole texts; a null or empty one has no spans; null ids and repeated rows are kept as
    they come; other columns are not looked at. Every run of 12 credential characters or
    more is scored, and so is the secret of every base match (null without a model). Base
    spans stay whatever their score; a run inside a base span is not reported twice, one
    that only holds or meets base spans is reported whole. Texts pass twice, to learn and
    to score, unless a ``model`` is given; nothing is shuffled but the bounded samples.
    """
    if model is None:
        model = learn(labelled(docs, id_col, text_col))

    def task(batches: Batches) -> Batches:
        memo: dict[str, float] = {}

        def score(run: str) -> float:
            text = shape(run)
            if text not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                if len(text) > LONGEST:  # too long to be worth remembering
                    return model.of_shape(text)
                memo[text] = model.of_shape(text)
            return memo[text]

        for batch in batches:
            bases, learned = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                bases.append([{"kind": k, "start": s, "end": e, "secret": x, "score": score(x) if model.kinds else None} for k, s, e, x in base])
                more = []
                for run in RUN.finditer(text) if model.kinds else ():
                    bits = score(run[0])
                    if bits >= BITS and not any(s <= run.start() and run.end() <= e for _, s, e, _ in base):
                        more.append({"kind": LEARNED, "start": run.start(), "end": run.end(), "score": bits})
                learned.append(more)
            fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(bases, pa.list_(pa.struct([*fields, ("secret", pa.string()), ("score", pa.float64())]))),
                    pa.array(learned, pa.list_(pa.struct([*fields, ("score", pa.float64())]))),
                ],
                ["doc_id", "base", "learned"],
            )

    source = documents(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, task, f"doc_id {kind}, base array<{SPAN}>, learned array<struct<kind:string,start:int,end:int,score:double>>")


def joined(*spans) -> "F.Column":
    """kind:start:end of arrays of spans, by start, then kind as listed, comma-joined."""
    order = F.array(*(F.lit(k) for k in (*KINDS, LEARNED)))
    plain = [F.transform(s, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("o"), x["end"].alias("end"), x["kind"].alias("kind"))) for s in spans]
    return F.array_join(F.transform(F.array_sort(F.concat(*plain)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
