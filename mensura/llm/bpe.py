"""Byte-level BPE by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens whose paths are the encodings: at first
one state with an arc to itself for each byte, then a merge gadget for each merge (u, v), in order. If the
state that u's arcs lead to has an arc v, a copy of it without that arc becomes the state u's arcs lead to,
and every state with an arc u gets an arc uv to where v's arcs lead. A copy shares the arcs of its source,
so a state is kept as (source, lost arc, number of the gadget) and its row of the transition table is read
through its sources.

A word has one path, and so has each of its beginnings: encoding walks it by the table, longest arc first,
and leaves places for good that lead nowhere. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mensura.llm.shared import narrowed, shipped, text_batches
from mensura.llm.wordids import byte_characters, gathered

STRETCH = 2_000_000  # characters split at a time
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Automaton:
    """States and arcs of a list of merges. ``labels``: the bytes of each token; ``lands``: the state that
    a token's arcs lead to, -1 for tokens that no arc has; state 0 is where words begin."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], limit: int = 300_000):
        raw = {c: b for b, c in byte_characters().items()}
        self.labels = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.labels[i] = bytes(map(raw.__getitem__, t)) if all(c in raw for c in t) else t.encode()
        n = len(self.labels)
        self.lands, self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n, [-1] * n
        self.source, self.lost, self.since = [0], [-1], [-1]
        self.gadget: dict[tuple[int, int], int] = {}
        self.tails: list[list[tuple[int, int]]] = []
        self.heads: list[list[tuple[int, int]]] = []
        for t, i in vocabulary.items():
            if len(t) == 1 and t in raw:
                self.lands[i] = 0
        for k, (x, y) in enumerate(merges):
            self._merge(k, vocabulary[x], vocabulary[y], vocabulary[x + y])
        self.tails, self.heads = [self._spine(self.right, t) for t in range(n)], [self._spine(self.left, t) for t in range(n)]
        self.arcs = {self.labels[i]: i for i in range(n) if self.lands[i] >= 0}
        self.reach: dict[bytes, int] = {}  # of each beginning of up to three bytes the longest label
        for x in self.arcs:
            self.reach[x[:3]] = max(self.reach.get(x[:3], 0), len(x))
        self.limit, self.table = limit, {}

    def _spine(self, child: list[int], t: int) -> list[tuple[int, int]]:
        """The token, its child, that one's child and so on, each with the number of the gadget that made
        the next longer one of it."""
        out, until = [], 1 << 62
        while t >= 0:
            out.append((t, until))
            t, until = child[t], self.born[t]
        return out

    def _merge(self, k: int, u: int, v: int, w: int) -> None:
        """The gadget of the k-th merge; none where no path has u and v in a row, or w has its arcs."""
        if self.lands[u] < 0 or self.lands[v] < 0 or self.lands[w] >= 0 or not self.arc(u, v):
            return
        self.lands[w] = self.lands[v]
        self.left[w], self.right[w], self.born[w] = u, v, k
        self.source.append(self.lands[u])
        self.lost.append(v)
        self.since.append(k)
        self.lands[u] = len(self.source) - 1
        self.gadget[u, v] = k

    def arc(self, u: int, v: int) -> bool:
        """Whether the state that u leads to has an arc v. It has lost v if u, or the end of u whose state
        u's is a copy of (for gadgets before that), lost v or what v's arcs grew from before they did."""
        gadget = self.gadget
        if self.tails:
            tails, heads = self.tails[u], self.heads[v]
        else:  # the gadgets so far
            tails, heads = self._spine(self.right, u), self._spine(self.left, v)
        for end, until in tails:
            for head, grown in heads:
                k = gadget.get((end, head))
                if k is not None and k < until and k <= grown:
                    return False
        return True

    def step(self, u: int, v: int) -> bool:
        """``arc`` by the table, whose used entries are kept."""
        key = (u << 32) | v
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= self.limit:
                self.table.clear()
            found = self.table[key] = self.arc(u, v)
        return found

    def path(self, word: bytes) -> list[int]:
        """The labels (token ids) of the word's path."""
        arcs, step, n = self.arcs, self.step, len(word)
        path: list[int] = []
        starts: list[int] = []
        left: set[int] = set()  # places that lead nowhere
        at, end = 0, self._end(word, 0)
        while at < n:
            while end > at:
                t = arcs.get(word[at:end])
                if t is not None and end not in left and (not path or step(path[-1], t)):
                    break
                end -= 1
            else:
                if not path:
                    raise ValueError(f"no token for a byte of {word!r}")
                left.add(at)
                path.pop()
                end, at = at - 1, starts.pop()
                continue
            path.append(t)
            starts.append(at)
            at = end
            end = self._end(word, at)
        return path

    def _end(self, word: bytes, at: int) -> int:
        """Where the longest arc that the word may take from here ends at most."""
        return min(len(word), at + self.reach.get(word[at : at + 3], 2))


# --- splitting -----------------------------------------------------------------------------------
# The pieces of byte-level vocabularies, in this order at each place.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = ["s", "t", "re", "ve", "m", "ll", "d"]
OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def kinds() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE for each code point."""
    out = np.zeros(0x110000, np.int8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        out[c] = LETTER if k == "L" else NUMBER if k == "N" else OTHER
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def cuts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of texts that begin at ``begins`` (sorted, no empty ones).

    A piece is a run of letters, numbers or others with one space before it, a contraction, or white
    space: a run of it less its last character unless the text ends there, and that character if it
    isn't a space, which goes with what follows."""
    n = len(points)
    kind = kinds()[points]
    first = np.zeros(n + 1, bool)
    first[begins] = first[n] = True
    cut = first[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = space & (np.r_[kind[1:], OTHER] != SPACE) & ~first[1:]  # of white space before other text
    cut |= last
    joined = np.flatnonzero(last & (points == 32)) + 1
    cut[joined] = False
    # Contractions: an apostrophe that begins a piece, alone, and the letters after it.
    alone = np.flatnonzero(cut & (points == 39) & ~first[1:])
    alone = alone[kind[alone + 1] == LETTER]
    p = np.r_[points, np.zeros(2, points.dtype)]
    b, c = p[alone + 1], p[alone + 2]
    inside = ~first[np.minimum(alone + 2, n)]
    size = np.where(np.isin(b, [ord(x) for x in SHORT if len(x) == 1]), 1, 0)
    for x in SHORT:
        if len(x) == 2:
            size[(b == ord(x[0])) & (c == ord(x[1])) & inside] = 2
    alone, size = alone[size > 0], size[size > 0]
    cut[alone + 1] = False
    after = alone + 1 + size
    cut[after[after < n]] = True
    return np.flatnonzero(cut)


def pieces(units: list[str], whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all units in a row as binary, and how many each unit has; units marked whole are
    one piece, empty ones none."""
    text = "".join(units)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = np.array([len(u) for u in units], np.int64)
    begin = np.cumsum(size) - size
    at = cuts(points, begin[size > 0])
    keep = np.ones(len(at), bool)
    for u in np.flatnonzero(whole):
        keep[np.searchsorted(at, begin[u] + 1) : np.searchsorted(at, begin[u] + size[u])] = False
    at = at[keep]
    wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    raw = text.encode()
    ends = np.r_[0, np.cumsum(wide)]
    offsets = np.r_[ends[at], len(raw)].astype(np.int64)
    out = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    return out, np.diff(np.searchsorted(at, np.r_[begin, len(points)]))


class Encoder:
    """Ids of texts by the automaton of a tokenizer file, each distinct piece walked once while it stays
    among the last ``limit`` ones."""

    def __init__(self, path: str, limit: int = 300_000):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        m = j["model"]
        plain = not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        bare = all(not x[k] for x in j["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        if m["type"] != "BPE" or not plain or not bare or j["normalizer"] is not None or j["pre_tokenizer"] != PRE_TOKENIZER:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.automaton = Automaton(m["vocab"], [tuple(x.split(" ") if isinstance(x, str) else x) for x in m["merges"]])
        self.added = {x["content"]: x["id"] for x in j["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        # No split piece reads as a whole added token, as its units are taken from the texts before.
        self.named = {x.encode(): np.array([i], "<i4").tobytes() for x, i in self.added.items()}
        self.limit, self.known = limit, dict(self.named)
        labels = self.automaton.labels + [b""] * (max(self.added.values(), default=0) + 1 - len(self.automaton.labels))
        for x, i in self.added.items():
            labels[i] = x.encode()
        self.flat = np.frombuffer(b"".join(labels), np.uint8)
        self.ends = np.r_[0, np.cumsum([len(x) for x in labels])].astype(np.int64)

    def _ids(self, piece: bytes) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = np.array(self.automaton.path(piece), "<i4").tobytes()
            if len(piece) <= 64:
                if len(self.known) >= self.limit:
                    self.known = dict(self.named)
                self.known[piece] = ids
        return ids

    def _units(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of a text that are split on their own, and whether one is an added token's. Long
        ones end before a space between two characters that aren't white space, where pieces do too."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            i = 0
            while len(part) - i > STRETCH and not k % 2:
                cut = _SEAM.search(part, i + STRETCH)
                if cut is None:
                    break
                yield part[i : cut.start() + 1], False
                i = cut.start() + 1
            yield part[i:] if i else part, bool(k % 2)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more entry than texts)."""
        flat: list[np.ndarray] = []
        size = np.zeros(len(texts), np.int64)
        units: list[str] = []
        whole: list[bool] = []
        owner: list[int] = []

        def take() -> None:
            found, count = pieces(units, np.array(whole, bool))
            known = found.dictionary_encode()
            packed = list(map(self._ids, known.dictionary.to_pylist()))
            ends = np.r_[0, np.cumsum([len(p) // 4 for p in packed])].astype(np.int64)
            ids, at = gathered(np.frombuffer(b"".join(packed), "<i4"), ends, known.indices.to_numpy(zero_copy_only=False))
            flat.append(ids)
            np.add.at(size, np.array(owner), np.diff(at[np.r_[0, np.cumsum(count)]]))
            units.clear(), whole.clear(), owner.clear()

        held = 0
        for k, text in enumerate(texts):
            for u, special in self._units(text):
                if u:
                    if held and held + len(u) > STRETCH:
                        take()
                        held = 0
                    units.append(u), whole.append(special), owner.append(k)
                    held += len(u)
        if units:
            take()
        return np.concatenate(flat) if flat else np.zeros(0, "<i4"), np.r_[0, np.cumsum(size)].astype(np.int64)

    def emit(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts that the arcs' labels spell; bytes that are no UTF-8 become replacement characters."""
        raw, at = gathered(self.flat, self.ends, ids)
        b, at = raw.tobytes(), at[starts]
        return [b[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:])]


_SEAM = re.compile(r"[!-~](?= [!-~])")


@functools.cache
def encoder(path: str) -> Encoder:
    """One a worker process."""
    return Encoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with one more column ``ids`` (array of int): the token ids of the text by the byte-level BPE
    file at ``path``, added tokens in the text included, none added. Null and empty texts have no ids.
    Repeated rows are repeated; a column of that name is replaced, all others stay."""
    return _mapped(docs, "text", "ids", "array<int>", functools.partial(_encoded, shipped(docs.sparkSession, path)))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encoded with one more column ``decoded``: the text that the labels of ``ids`` spell; null
    ids spell ''. A column of that name is replaced, all others stay."""
    return _mapped(encoded, "ids", "decoded", "string", functools.partial(_decoded, shipped(encoded.sparkSession, path)))


def _mapped(df: DataFrame, column: str, name: str, kind: str, f) -> DataFrame:
    """df with the column that f makes of an Arrow array of another."""
    text_batches(df.sparkSession)
    packed, columns = narrowed(df.drop(name), column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), f(batch.column(0))], names=[column, "rest", name])

    schema = f"{column} {packed.schema[column].dataType.simpleString()}, rest {packed.schema['rest'].dataType.simpleString()}, {name} {kind}"
    return packed.mapInArrow(run, schema).select(*columns, name)


def _encoded(path: Callable[[], str], texts: pa.Array) -> pa.Array:
    ids, starts = encoder(path()).encode([t or "" for t in texts.to_pylist()])
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _decoded(path: Callable[[], str], lists: pa.Array) -> pa.Array:
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return pa.array(encoder(path()).emit(lists.flatten().to_numpy(), np.r_[0, np.cumsum(size)]), pa.string())
