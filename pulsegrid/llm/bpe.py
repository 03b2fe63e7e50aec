"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The tokenizer is a vocabulary file of the kind "BPE with word ends": NFC, white space
runs to one blank, lower case; words are runs of letters, single numbers, runs of other
marks, and the English clitics; bytes stand for themselves in a 256-letter alphabet.
"""

import json
import unicodedata
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from pulsegrid.llm.batches import Batches, documents, map_batches

#: Words, and stretches between white space, whose ids a task remembers (some 200 bytes
#: each); beyond that it starts anew. No more words than stretches are remembered.
MEMO_WORDS, MEMO_STRETCHES = 200_000, 60_000
#: Code points of text that are cut at once, and of texts whose ids and decoded forms a task
#: holds before it hands them on.
AT_ONCE, HELD = 1 << 20, 1 << 19
#: Words of at most so many bytes are merged many at a time, at most so many.
SHORT, TOGETHER = 64, 4096

#: Rank of what is no pair, and the symbol of a place without one.
NO_MERGE, NO_SYMBOL = 1 << 30, 1 << 19


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge_word(ids: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Merge adjacent ids, always the leftmost pair of the lowest rank, until none is left.

    ``merges`` has rank and new id by ``left << 20 | right``. Leaf i of the tree holds the
    rank of the pair that starts at symbol i; every inner node holds the least rank below,
    so the root tells the next merge, a walk down the leftmost equal child finds its place,
    and a merge changes three leaves.
    """
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    tree = [NO_MERGE] * (2 * size)
    found = merges.get
    for i in range(n - 1):
        pair = found(ids[i] << 20 | ids[i + 1])
        if pair:
            tree[size + i] = pair[0]
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right
    symbols, after, before = [*ids], [*range(1, n), -1], [*range(-1, n - 1)]

    def put(place: int, rank: int) -> None:
        node = size + place
        tree[node] = rank
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left <= right else right
            if tree[node] == least:
                break
            tree[node] = least

    def rank_at(place: int) -> int:
        right = after[place]
        pair = found(symbols[place] << 20 | symbols[right]) if right >= 0 else None
        return pair[0] if pair else NO_MERGE

    while tree[1] != NO_MERGE:
        node, least = 1, tree[1]
        while node < size:
            node *= 2
            if tree[node] != least:
                node += 1
        place = node - size
        gone = after[place]
        symbols[place] = merges[symbols[place] << 20 | symbols[gone]][1]
        after[place] = after[gone]
        if after[gone] >= 0:
            before[after[gone]] = place
        symbols[gone] = -1
        put(gone, NO_MERGE)
        put(place, rank_at(place))
        if before[place] >= 0:
            put(before[place], rank_at(before[place]))
    return [x for x in symbols if x >= 0]


def _strings(array: pa.StringArray) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _slices(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` values from each of ``starts`` on, one slice after another."""
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(starts - ends + counts, counts)
    return values[at]


class Memo:
    """Ids of strings. They lie in arrays, so that those of many strings are taken at once."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids = np.array([], "<u4")
        self.starts = self.counts = np.array([], np.int64)

    def __len__(self) -> int:
        return len(self.place)

    def places(self, strings: list[str]) -> tuple[np.ndarray, list[str]]:
        """The place of each of different strings, and those not known yet: they are to be added
        in this order, and have the places they get then."""
        places = np.fromiter(map(self.place.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(places < 0)
        places[new] = len(self) + np.arange(len(new))
        return places, [strings[i] for i in new.tolist()]

    def add(self, strings: list[str], ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Take in strings not known yet; those of a string are ``counts`` of ``ids`` from ``starts`` on."""
        self.place.update(zip(strings, range(len(self), len(self) + len(strings)), strict=True))
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at ``places``, one string after another, and how many each has."""
        counts = self.counts[places]
        return _slices(self.ids, self.starts[places], counts), counts


class Encoder:
    """Texts to ids and back, by one vocabulary file."""

    def __init__(self, path: str, stretches: int = MEMO_STRETCHES):
        self.stretches = stretches
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        merges = spec["model"]["merges"]
        pairs = [vocab[left] << 20 | vocab[right] for left, right in merges]
        self.made = np.array([vocab[left + right] for left, right in merges])
        self.merges = {pair: (rank, int(self.made[rank])) for rank, pair in enumerate(pairs)}
        order = np.argsort(pairs)
        self.pairs, self.ranks = np.array(pairs)[order], order.astype(np.int32)
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters])
        self.last = np.array([vocab[x + end] for x in letters])
        # ranks of two bytes that stand together, by left << 8 | right
        self.inner_ranks = self._rank(np.repeat(self.inner, 256), np.tile(self.inner, 256))
        self.last_ranks = self._rank(np.repeat(self.inner, 256), np.tile(self.last, 256))
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: token for token, i in (vocab | self.added).items()}
        self.solid = regex.compile(r"\P{White_Space}+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        words = r"\p{L}+|'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
        self.words = regex.compile(words)
        self.words_and_blanks = regex.compile(r"\p{L}+| |" + words)
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered, at the end of a task."""
        self.known, self.memo = Memo(), self._added_alone()

    def _added_alone(self) -> Memo:
        memo, each = Memo(), np.arange(len(self.added))
        memo.add([*self.added], np.array([*self.added.values()], "<u4"), each, np.ones_like(each))
        return memo

    def split(self, text: str) -> list[str]:
        """The words of a text; added tokens stand alone and are not normalized."""
        if self.cut is not None and self.cut.search(text):
            return [
                word
                for part in self.cut.split(text)
                for word in ([part] if part in self.added else self._words(part))
            ]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        return self.words.findall(self._normalized(text))

    def _normalized(self, text: str) -> str:
        # No word holds white space, so that can stay as it is. Letter by letter: no final sigma.
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        No word crosses white space, so what stands between white space is looked up as it
        is written; only what is not known yet is normalized, cut into words and merged.
        """
        stretches, in_text = self._stretches(texts)
        coded = stretches.dictionary_encode()
        distinct = _strings(coded.dictionary)
        places, new = self.known.places(distinct)
        if len(self.known) + len(new) > self.stretches:
            self.known = Memo()
            places, new = self.known.places(distinct)
        if len(self.memo) > min(MEMO_WORDS, self.stretches):
            self.memo = self._added_alone()
        if new:
            self._learn_stretches(new)
        ids, counts = self.known.take(places[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(in_text)].tolist()
        data = ids.tobytes()
        return [data[4 * start : 4 * end] for start, end in zip([0, *ends], ends, strict=False)]

    def batches_of(self, texts: list[str]) -> list[bytes]:
        """``encode_batch`` of as many texts at once as are about AT_ONCE code points long."""
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= AT_ONCE:
                out += self.encode_batch(some)
                some, size = [], 0
        return out + self.encode_batch(some)

    def _stretches(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """What stands between white space in the texts, and how many of these each text has.

        Empty strings may be among them; they have no ids.
        """
        # Arrow and str.split() also cut at four control characters that are no white space here
        odd = [any(mark in text for mark in "\x1c\x1d\x1e\x1f") for text in texts]
        if any(odd):
            cut = [self.solid.findall(text) if is_odd else text.split() for text, is_odd in zip(texts, odd, strict=True)]
            return pa.array(chain.from_iterable(cut), pa.string()), np.array([len(x) for x in cut])
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        return lists.flatten(), lists.value_lengths().to_numpy()

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def _learn_stretches(self, new: list[str]) -> None:
        """Put stretches into their memo."""
        words, counts = self._cut(new)
        coded = words.dictionary_encode()
        places, unknown = self.memo.places(_strings(coded.dictionary))
        if unknown:
            self._learn(unknown)
        ids, of_word = self.memo.take(places[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(of_word)])[np.cumsum(counts)]
        starts = np.concatenate([[0], ends[:-1]])
        self.known.add(new, ids, starts, ends - starts)

    def _cut(self, stretches: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The words of all stretches and how many each has; all without an added token are
        normalized and cut in one string, blanks between."""
        special = {i: self.split(x) for i, x in enumerate(stretches) if "<|" in x}
        joined = self._normalized(" ".join(["" if i in special else x for i, x in enumerate(stretches)] if special else stretches))
        found = self.words_and_blanks.findall(joined)
        if special:
            found, blanks, at = [], found, 0
            for token in [*blanks, " "]:
                if token == " ":
                    found += special.get(at, ())
                    at += 1
                found.append(token)
            found.pop()
        tokens = pa.array(found, pa.string())
        blank = pc.equal(tokens, " ")
        ends = np.append(np.flatnonzero(blank.to_numpy(zero_copy_only=False)), len(tokens))
        return tokens.filter(pc.invert(blank)), np.diff(ends, prepend=-1) - 1

    def _learn(self, words: list[str]) -> None:
        """Put words into their memo. Short words of like length go through the tree together."""
        letters = pa.array(words, pa.string())
        at = np.frombuffer(letters.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
        data, long = np.frombuffer(letters.buffers()[2], np.uint8), np.diff(at)
        order = np.argsort(long, kind="stable")
        short = int(np.searchsorted(long[order], SHORT, side="right"))
        parts, counts = [], np.zeros(len(words), np.int64)
        for first in range(0, short, TOGETHER):
            some = order[first : min(first + TOGETHER, short)]
            ids, counts[some] = self._merge_rows(data, at[some], long[some])
            parts.append(ids)
        for i in order[short:].tolist():
            word = data[at[i] : at[i + 1]]
            ids = merge_word([*self.inner[word[:-1]].tolist(), int(self.last[word[-1]])], self.merges)
            counts[i] = len(ids)
            parts.append(np.array(ids, "<u4"))
        starts = np.empty_like(counts)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        self.memo.add(words, np.concatenate(parts), starts, counts)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 20 | right
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[place] == pair, self.ranks[place], NO_MERGE)

    def _merge_short(self, words: list[bytes], size: int) -> list[bytes]:
        """``merge_word`` for many words of at most ``size`` bytes."""
        long = np.array([len(word) for word in words])
        ids, counts = self._merge_rows(np.frombuffer(b"".join(words), np.uint8), np.cumsum(long) - long, long, size)
        ends = np.cumsum(counts).tolist()
        return [ids[start:end].tobytes() for start, end in zip([0, *ends], ends, strict=False)]

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, long: np.ndarray, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """``merge_word`` for many words: ``long`` bytes of ``data`` from ``starts`` on. Ids of
        one word after another, and how many each has.

        There is one tree a word, of ``size`` leaves at least; a word is a column, a node or
        place a row, so that a level of all trees is made at once from the one below. Place
        ``size`` of symbols, after and before stands for "none"; it never pairs.
        """
        size = max(size, 1 << (int(long.max()) - 1).bit_length())
        count, place = len(long), np.arange(size)[:, None]
        letters = data[np.minimum(starts + place, len(data) - 1)]
        column, final = np.arange(count), long - 1
        symbols = np.full((size + 1, count), NO_SYMBOL, np.int32)
        symbols[:size] = np.where(place < final, self.inner[letters], NO_SYMBOL)
        symbols[final, column] = self.last[letters[final, column]]
        after = np.repeat(np.minimum(np.arange(1, size + 2), size)[:, None], count, axis=1)
        before = np.repeat(np.append(size, np.arange(size))[:, None], count, axis=1)
        tree = np.full((2 * size, count), NO_MERGE, np.int32)
        pair = letters[:-1].astype(np.int64) << 8 | letters[1:]
        tree[size:-1] = np.where(place[:-1] < final - 1, self.inner_ranks[pair], NO_MERGE)
        column = column[final > 0]
        tree[size + final[column] - 1, column] = self.last_ranks[pair[final[column] - 1, column]]
        merged, kept = np.empty((size, count), np.int32), np.arange(count)
        while True:
            half = size
            while half > 1:
                np.minimum(tree[half : 2 * half : 2], tree[half + 1 : 2 * half : 2], out=tree[half // 2 : half])
                half //= 2
            column = np.flatnonzero(tree[1] != NO_MERGE)
            if 4 * len(column) < 3 * len(kept):  # put finished words aside
                merged[:, kept] = symbols[:size]
                if not len(column):
                    break
                kept = kept[column]
                symbols, after, before, tree = (x.take(column, axis=1) for x in (symbols, after, before, tree))
                column = np.arange(len(kept))
            self._merge_once(column, symbols, after, before, tree)
        there = merged.T != NO_SYMBOL
        return merged.T[there].astype("<u4"), there.sum(1)

    def _merge_once(self, column: np.ndarray, *parts: np.ndarray) -> None:
        """Merge the pair of least rank in each word of ``column``; changes symbols, after,
        before and the leaves of the tree."""
        width, size = parts[0].shape[1], len(parts[0]) - 1
        symbols, after, before, tree = (x.reshape(-1) for x in parts)
        node, least = np.ones_like(column), tree[width + column]
        for _ in range(size.bit_length() - 1):
            node *= 2
            node += tree[node * width + column] != least
        place = node - size
        here = place * width + column
        gone = after[here] * width + column
        following, previous = after[gone], before[here]
        symbols[here] = made = self.made[least]
        symbols[gone] = NO_SYMBOL
        after[here] = following
        right, left = following * width + column, previous * width + column
        before[right] = place
        leaves = size * width
        tree[leaves + gone] = NO_MERGE
        tree[leaves + here] = self._rank(made, symbols[right])
        # the last leaf starts no pair: what has no place goes there
        left_leaf = np.minimum(previous, size - 1) * width + column
        tree[leaves + left_leaf] = self._rank(symbols[left], made)

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, blanks between."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def encoder(path: str, stretches: int = MEMO_STRETCHES) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path, stretches)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(batch: pa.RecordBatch) -> Batches:
    """``batch`` of ids and texts in slices of about HELD code points."""
    ends = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False))
    cuts = (np.flatnonzero(np.diff(ends // HELD)) + 1).tolist()
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def encoded(coder: Encoder, batches: Batches) -> Batches:
    """Ids of documents, the token ids of their texts and what these decode to.

    Only a slice of a batch is there as strings, ids and decoded texts at a time.
    """
    for piece in chain.from_iterable(map(pieces, batches)):
        ids = coder.batches_of(piece.column(1).to_pylist())
        yield pa.record_batch(
            [piece.column(0), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())],
            ["doc_id", "ids", "decoded"],
        )


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and what they decode to: doc_id, ids, decoded.

    ``ids`` is binary, little-endian unsigned 32-bit. One pass without a shuffle. A null
    or empty text has no ids and decodes to the empty string; a null doc_id and repeated
    rows are kept as they come; other columns of ``docs`` are not looked at.
    """

    def task(batches: Batches) -> Batches:
        coder = encoder(path)
        yield from encoded(coder, batches)
        coder.forget()

    source = documents(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, task, f"doc_id {kind}, ids binary, decoded string")
