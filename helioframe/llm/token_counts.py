"""Token counts: greedy longest-match pieces counted in linear time by a trie with failure links.

The automaton is the trie of a vocabulary of byte strings.  Where a trie node has no edge for the next byte, the greedy
pieces of its string are popped and the walk goes on at its failure node, the longest rest that is a trie node again; only
the number of popped pieces is stored, so no piece is ever built.  ``tail`` sums the pops down to the root for the end of a word.
Every single byte counts as a vocabulary entry, so each word has a segmentation.

A text is cut at ``[\\x20\\x09-\\x0D]``; every word is matched with a space in front, as byte-level vocabularies write it.
The vocabulary has a fixed size, so the automaton is broadcast.

Defined cases: null, empty and blank texts have no words and no tokens; words of any length are walked once; rows repeat as
they come; empty tables give no rows; input columns travel inside ``row`` and cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import packed

MEMO, MEMO_BYTES = 500_000, 64


def byte_vocabulary(path: str) -> list[bytes]:
    """Entries of a byte-level vocabulary file as the bytes they stand for.

    Such files show every byte as a printable character: printable Latin-1 as itself, the others from U+0100 on in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    return [bytes(of[c] for c in token) for token in model["model"]["vocab"] if token not in special]


class Automaton:
    """Counts the greedy longest-match pieces of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        edges: dict[int, int] = {}
        ends, children = [False], [[]]
        for entry in [bytes([b]) for b in range(256)] + sorted(vocabulary):
            node = 0
            for byte in entry:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(ends)
                    children[node].append(byte)
                    ends.append(False)
                    children.append([])
                node = edges[key]
            ends[node] = bool(node) or ends[node]
        fail, pops, tail = [0] * len(ends), [0] * len(ends), [0] * len(ends)
        todo = [0]
        for node in todo:
            for byte in children[node]:
                child = edges[node << 8 | byte]
                if ends[child]:
                    pops[child] = 1
                else:
                    popped, at = pops[node], fail[node]
                    while at << 8 | byte not in edges:
                        popped, at = popped + pops[at], fail[at]
                    fail[child], pops[child] = edges[at << 8 | byte], popped
                tail[child] = pops[child] + tail[fail[child]]
                todo.append(child)
        self.edges, self.fail, self.pops, self.tail = edges, fail, pops, tail

    def count(self, word: bytes) -> int:
        edges, node, n = self.edges, 0, 0
        for byte in word:
            while (step := edges.get(node << 8 | byte)) is None:
                n += self.pops[node]
                node = self.fail[node]
            node = step
        return n + self.tail[node]


class Memo(dict):
    """Counts of words seen before; bounded, and long words are never kept."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


def counted(documents: DataFrame, vocabulary: Iterable[bytes], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (its columns ``keep``, all by default), n_words, n_tokens, longest (tokens of its longest word)."""
    sent = documents.sparkSession.sparkContext.broadcast(Automaton(vocabulary))
    source = packed(documents, text, keep)
    schema = T.StructType([source.schema["row"], *T._parse_datatype_string("n_words long, n_tokens long, longest long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(sent.value)
        for batch in batches:
            made = []
            for body in batch.column(1):
                words = (body.as_py() or b"").split()
                counts = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                made.append((len(words), int(counts.sum()), int(counts.max(initial=0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in made], pa.int64()) for k in range(3))], names=schema.names)

    return source.mapInArrow(run, schema)
