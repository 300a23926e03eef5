"""Token ids of whole texts from a ``tokenizers`` file, each distinct piece encoded once a worker."""

from __future__ import annotations

import functools
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The settings of a tokenizer file under which the ids of a text are those of its
# chunks between white space, and those of a chunk of plain characters the ids of its pieces.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
_PIECE = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
STRETCH = 6_000_000  # bytes of text taken at a time


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _ends(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def gathered(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of flat, run i being flat[ends[i]:ends[i + 1]], in a row; and where each ends."""
    size = np.diff(ends)[which]
    out = _ends(size)
    return flat[np.repeat(ends[:-1][which] - out[:-1], size) + np.arange(out[-1])], out


class _Cache(dict):
    """Packed ids by key, made by ``make``; long keys are not kept, and a full cache starts again."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = ids
        return ids


class WordIds:
    """Ids of texts. A tokenizer file with the settings above has its chunks told apart by Arrow and
    each distinct one looked up once: plain ones piece by piece through the library's model, all
    others through the whole library. Texts of any other file go through the whole library."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model, self.bytes = self.tokenizer.model, byte_characters()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        bare = all(not x[k] for x in settings["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        self.by_chunk = settings["normalizer"] == NORMALISER and settings["pre_tokenizer"] == SPLITTER and settings["model"].get("type") == "BPE"
        self.by_chunk = self.by_chunk and bare and not settings["model"].get("dropout") and not any(c.isspace() for x in self.special for c in x)
        self.pieces, self.chunks = _Cache(self._piece, limit), _Cache(self.whole, limit)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, p: str) -> bytes:
        s = p if p.isascii() else p.encode().decode("latin-1").translate(self.bytes)
        return self.pack([t.id for t in self.model.tokenize(s)]) if s else b""

    def _looked_up(self, keys: pa.Array, cache: _Cache) -> tuple[np.ndarray, np.ndarray]:
        packed = list(map(cache.__getitem__, keys.to_pylist()))
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
        return np.frombuffer(b"".join(packed), self.dtype), _ends(size)

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.and_(pc.match_substring_regex(chunks, _PLAIN), pc.less_equal(pc.binary_length(chunks), 256))
        for x in self.special:
            plain = pc.and_not(plain, pc.match_substring(chunks, x))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(chunks.filter(plain)), _PIECE, r"\1 "))
        pieces = cut.flatten().dictionary_encode()
        ids, at = gathered(*self._looked_up(pieces.dictionary, self.pieces), pieces.indices.to_numpy())
        at = at[cut.offsets.to_numpy()]
        other, there = self._looked_up(chunks.filter(pc.invert(plain)), self.chunks)
        rank = np.empty(len(chunks), np.int64)  # of each chunk among the plain ones, then the others
        which = plain.to_numpy(zero_copy_only=False)
        rank[which], rank[~which] = np.arange(len(at) - 1), np.arange(len(there) - 1) + len(at) - 1
        return gathered(np.concatenate([ids, other]), np.concatenate([at, there[1:] + at[-1]]), rank)

    def _of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's end (one more entry than texts)."""
        if not self.by_chunk:
            packed = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(packed), self.dtype), _ends(np.array([len(p) for p in packed], np.int64) // self.dtype.itemsize)
        cut = pc.ascii_split_whitespace(texts)
        chunks = cut.flatten().dictionary_encode()
        ids, at = gathered(*self._chunk_ids(chunks.dictionary), chunks.indices.to_numpy())
        return ids, at[cut.offsets.to_numpy()]

    def _stretches(self, raw: bytes) -> Iterator[bytes]:
        """A long text in parts that end before white space."""
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > STRETCH and self.by_chunk:
                end = max(raw.rfind(b" ", at + 1, at + STRETCH), raw.rfind(b"\n", at + 1, at + STRETCH))
                if end < 0:
                    end = min((x for x in (raw.find(b" ", at + STRETCH), raw.find(b"\n", at + STRETCH)) if x > 0), default=len(raw))
            yield raw[at:end]
            at = end

    def of(self, text: str | None) -> bytes:
        """The ids of a whole text, packed; null is empty."""
        return b"".join(self._of(pa.array([x], pa.large_binary()).cast(pa.large_string()))[0].tobytes() for x in self._stretches((text or "").encode()))

    def ended(self, texts: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, their ids with ``end`` after each text as little-endian unsigned
        32-bit numbers, where each text's ids end) for runs of rows of bounded size; null is empty."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
        before, i = _ends(size), 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(before, before[i] + STRETCH, side="right")) - 1)
            if size[i] > STRETCH:
                j = i + 1
                ids = np.frombuffer(self.of(texts[i].as_py()), self.dtype)
                at = np.array([0, len(ids)])
            else:
                ids, at = self._of(pc.fill_null(texts.slice(i, j - i), ""))
            out = np.empty(len(ids) + j - i, "<u4")
            ends = at[1:] + np.arange(j - i)
            own = np.ones(len(out), bool)
            own[ends] = False
            out[own], out[ends] = ids, end
            yield i, j, out, np.concatenate([[0], ends + 1])
            i = j


@functools.cache
def word_ids(path: str) -> WordIds:
    """One a worker process."""
    return WordIds(path)
