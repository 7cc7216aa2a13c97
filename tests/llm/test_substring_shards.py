"""A shard of op4 without Spark: the automaton over the dictionary decides what recurs."""

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from pairwright.llm import substring_dedup as sd
from pairwright.llm.wordnum import text_chunks

TEXT = " ".join(f"w{i}" for i in range(60))


class Task:
    """Takes the place of a DataFrame and hands out the function that a task runs."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def pack(text):
    return zstandard.ZstdCompressor().compress(text.encode())


def shard_rows(phrases, texts, shard=0):
    """Batches of one shard: a phrase, a class or a text a row."""
    kinds = [0] * len(phrases) + [1] * len(texts) + [2] * len(texts)
    keys = [None] * len(phrases) + list(range(len(texts))) * 2
    bodies = [p.encode() for p in phrases] + [None] * len(texts) + [pack(t) for t in texts]
    n = len(kinds)
    columns = {
        "shard": pa.array([shard] * n, pa.int64()), "kind": pa.array(kinds, pa.int32()), "id": pa.array(keys, pa.int64()),
        "k": pa.array(keys, pa.int64()), "k2": pa.array(keys, pa.int64()), "i": pa.array(keys, pa.int64()),
        "number": pa.array(keys, pa.int64()), "body": pa.array(bodies, pa.binary()),
        "firsts": pa.nulls(n, pa.list_(pa.int32())), "copy": pa.array([False] * n)}
    return pa.RecordBatch.from_pydict(columns)


def windows(*batches):
    task = Task()
    sd.windows(task)
    return [(at >> sd.START_BITS, at & ((1 << sd.START_BITS) - 1)) for out in task.run(iter(batches))
            for at in out.column("at").to_pylist()]


def kept_phrase(text):
    """The kept phrase of the text's first window, and the starts of the windows that keep it."""
    chunk = next(text_chunks(pa.array([text])))
    values, low, whole = sd._kept_phrases(chunk.hashes(), sd._documents(chunk))
    words, at = text.split(), values.tolist().index(low[0])
    assert at in sd._kept_places(values, low, whole)
    return " ".join(words[at: at + sd.PHRASE]), np.flatnonzero(low == low[0]).tolist()


def test_kept_places_are_those_of_the_window_minima():
    texts = pa.array([TEXT, "few words", "", TEXT.replace("w1", "v"), "x " * 50])
    chunk = next(text_chunks(texts))
    values, low, whole = sd._kept_phrases(chunk.hashes(), sd._documents(chunk))
    want = {p for w in np.flatnonzero(whole) for p in range(w, w + 13) if values[p] == min(values[w: w + 13])}
    assert set(sd._kept_places(values, low, whole).tolist()) == want
    assert all(low[w] == min(values[w: w + 13]) for w in range(len(low)))


def test_words_decide_where_numbers_are_equal(monkeypatch):
    """With one number for all words the automaton hits everywhere; the words of a hit are compared."""
    monkeypatch.setattr(sd, "_numbers", lambda hashes: hashes & np.uint64(0))
    phrase, starts = kept_phrase(TEXT)
    assert windows(shard_rows([phrase, "a b c d e f g h"], [TEXT])) == [(0, s) for s in starts]
    assert windows(shard_rows(["a b c d e f g h"], [TEXT])) == []


def test_located_by_the_dictionary_alone():
    phrase, starts = kept_phrase(TEXT)
    assert windows(shard_rows([phrase], [TEXT])) == [(0, s) for s in starts]
    assert windows(shard_rows([], [TEXT])) == []                          # no automaton, no repeats
    other = phrase.split()
    other[3] = "else"
    assert windows(shard_rows([" ".join(other)], [TEXT])) == []           # every word counts
    again = TEXT.replace(" ", "\n\t ")
    assert windows(shard_rows([phrase], [TEXT, again])) == [(d, s) for d in (0, 1) for s in starts]


def test_shards_share_nothing_and_may_span_batches():
    phrase, starts = kept_phrase(TEXT)
    rows = shard_rows([phrase], [TEXT])
    parts = [rows.slice(j, 1) for j in range(rows.num_rows)]
    assert windows(*parts) == [(0, s) for s in starts]
    assert windows(rows, shard_rows([], [TEXT], shard=1), shard_rows([phrase], [TEXT], shard=2)) == [(0, s) for s in starts] * 2


def test_phrase_does_not_reach_into_the_next_text():
    phrase, _ = kept_phrase(TEXT)
    words = phrase.split()
    split = ["a b c " * 7 + " ".join(words[:4]), " ".join(words[4:]) + " x y z" * 7]
    assert windows(shard_rows([phrase], split)) == []


def test_too_many_words_raise(monkeypatch):
    phrase, _ = kept_phrase(TEXT)
    monkeypatch.setattr(sd, "START_BITS", 5)
    with pytest.raises(ValueError, match="words"):
        windows(shard_rows([phrase], [TEXT]))


def test_phrases_are_spelled_without_their_white_space():
    texts = ["  a\tb  c d\ne f g h i j ", "a b c d e f g h i j"]
    chunk = next(text_chunks(pa.array(texts)))
    spelled = sd._spelled(chunk, np.array([0, 1, 2, 10, 11, 12]))
    assert spelled[:3] == spelled[3:] == [b"a b c d e f g h", b"b c d e f g h i", b"c d e f g h i j"]
