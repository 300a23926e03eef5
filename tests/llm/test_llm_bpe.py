"""The tokenization automaton against the tokenizers library."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
import regex

from mensura.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = (
    "a b e t h ' 's 're 'll 'S 0 12 ½ ² é ß 日本 😀 ! ... <|endoftext|> <|end the and aaaa _ ́ ǅ ـ".split(" ")
    + [" ", "  ", "\n", "\r\n", "\t", "　", "\xa0", "\x85", "​"]
)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(4000)]
    spelled = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    return mixed + spelled + ["a" * n for n in range(1, 150)] + ["ab" * 200, " " * 1000, "=-" * 2000, "<|endoftext|>" * 3, "x" * 50_000]


def test_ids_and_texts_equal_the_library(library, texts):
    e = bpe.encoder(PATH)
    ids, starts = e.encode(texts)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[i:j].tolist() for i, j in zip(starts, starts[1:])] == want
    assert e.emit(ids, starts) == [library.decode(w, skip_special_tokens=False) for w in want] == texts


def test_pieces_equal_the_pattern(texts):
    pattern = regex.compile(bpe.PIECE)
    for t in texts:
        if t and "<|endoftext|>" not in t:
            assert [p.decode() for p in bpe.pieces([t], np.array([False]))[0].to_pylist()] == pattern.findall(t)


def test_long_texts_are_cut_where_pieces_begin(library, texts, monkeypatch):
    long = " ".join(texts[:600])
    monkeypatch.setattr(bpe, "STRETCH", 500)
    ids, starts = bpe.Encoder(PATH).encode(["", long, "", long])
    want = library.encode(long, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and starts.tolist() == [0, 0, len(want), len(want), 2 * len(want)]


def test_gadgets_leave_one_path_a_word():
    """On a small list of merges: the automaton's paths are the merges' results, and no other path spells
    the word."""
    chars = {c: b for b, c in bpe.byte_characters().items()}
    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("b", "ab"), ("aa", "aa"), ("c", "a"), ("b", "b"), ("aba", "b")]
    names = [*"abc", *dict.fromkeys(x + y for x, y in merges)]
    m = bpe.Automaton({t: i for i, t in enumerate(names)}, merges)
    assert all(c in chars for c in "abc")

    def merged(word):
        parts = list(word)
        for x, y in merges:
            i = 0
            while i + 1 < len(parts):
                if parts[i] == x and parts[i + 1] == y:
                    parts[i : i + 2] = [x + y]
                i += 1
        return parts

    def paths(word, last=None):
        if not word:
            return [[]]
        out = []
        for t in names:
            i = names.index(t)
            if word.startswith(t) and m.lands[i] >= 0 and (last is None or m.arc(last, i)):
                out += [[t, *p] for p in paths(word[len(t) :], i)]
        return out

    rng = random.Random(1)
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        assert paths(word) == [merged(word)] == [[names[i] for i in m.path(word.encode())]]


def test_encode_and_decode_keep_columns_and_handle_odd_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "It's <|endoftext|> so.", None), (3, "It's <|endoftext|> so.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = bpe.decode(bpe.encode(docs.withColumnRenamed("decoded", "rest"), PATH), PATH)
    assert out.columns == ["doc_id", "text", "rest", "ids", "decoded"]
    assert sorted(((r["doc_id"], r["text"], len(r["ids"]), r["decoded"]) for r in out.collect()), key=repr) == sorted([(1, None, 0, ""), (2, "", 0, ""), *[(3, rows[2][1], 6, rows[2][1])] * 2], key=repr)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    j = json.load(open(PATH, encoding="utf-8"))
    j["model"]["ignore_merges"] = True
    (tmp_path / "x.json").write_text(json.dumps(j))
    with pytest.raises(ValueError):
        bpe.Encoder(str(tmp_path / "x.json"))
