"""Byte-pair encoding and decoding with a deterministic automaton of the merges.

``Automaton`` is compiled from the merge list alone. At first there is one state, from which every
byte leads back to it. Then each merge (u, v) puts its gadget in place, in the order of ranks: the
arcs labelled u go to a copy of their state that lacks the arc v, and wherever u can be read an arc
labelled uv leads on to the state behind v. In the end the paths from the start are the encodings
of all byte strings, one path a string, so greedy merging is never replayed. The state is known from
the last label. A gadget takes one arc and those that later grow out of it; labels are numbered so
that these are a run of numbers, and a state is its table of missing runs.

A word is encoded from left to right: from each place reached, the arcs whose labels are spelled
there reach the next places; every place is reached once. Texts are split at added tokens, then into
words by the byte-level rule; words met before are looked up in a bounded store. Decoding emits the
bytes of the arc labels; bytes that are no UTF-8 become replacement characters.

Null reads as the empty text, which has no tokens. Repeated rows and rows without an id are encoded
one by one; an empty table gives an empty result; other columns are not read. Long texts are hashed
as they go, and a word of any length takes time in proportion to it.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemetrics.llm.common import ship

CACHED_WORDS = 500_000
CACHED_LENGTH = 64
#: Tokens that are hashed and decoded at once, and letters of a text that are split at once.
BLOCK_TOKENS = 1 << 16
BLOCK_LETTERS = 1 << 16

# The word pattern of byte-level vocabularies.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: The same on text of ASCII letters alone, for a plainer engine.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

LABEL = -1
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves,
    the others for the letters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


def _arc(cuts: list[tuple[bytes, int]], parent: dict[bytes, tuple[bytes, int]], label: bytes) -> bool:
    """Whether a state with these gadgets still has an arc: neither it nor one it grew out of is gone."""
    grew = {label: float("inf")}
    while label in parent:
        label, rank = parent[label]
        grew[label] = rank
    return not any(cut in grew and rank <= grew[cut] for cut, rank in cuts)


class Automaton:
    """States and arcs after all merge gadgets; a state is named by the label that leads to it."""

    def __init__(self, labels: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        """``labels``: the id of each token by its bytes; ``merges`` in the order of their ranks."""
        known = {bytes([b]): None for b in range(256) if bytes([b]) in labels}
        #: Per state the gadgets that apply to it, as (label taken away, rank of the gadget).
        gadgets: dict[bytes, list[tuple[bytes, int]]] = {x: [] for x in known}
        grown: dict[bytes, list[tuple[int, bytes]]] = {x: [] for x in known}
        parent: dict[bytes, tuple[bytes, int]] = {}
        idle: set[bytes] = set()
        for rank, (u, v) in enumerate(merges):
            new = u + v
            if any(x not in known and x not in idle for x in (u, v)) or new in known or new not in labels:
                raise ValueError(f"merge {rank} does not join two earlier tokens to a new one")
            if u in idle or v in idle or not _arc(gadgets[u], parent, v):
                idle.add(new)  # the two never meet, so the gadget changes no path
                continue
            idle.discard(new)
            known[new] = None
            parent[new] = u, rank
            gadgets[new] = list(gadgets[v])
            grown[new] = []
            gadgets[u].append((v, rank))
            grown[u].append((rank, new))
        self._number(known, grown)
        #: The id of each numbered label, and the runs of numbers that its state lacks.
        self.ids = [0] * len(known)
        self.missing: list[tuple[list[int], list[int]]] = [([], [])] * len(known)
        for label, cuts in gadgets.items():
            self.ids[self.number[label]] = labels[label]
            self.missing[self.number[label]] = self._runs(cuts)
        #: A tree of the labels' bytes; at ``LABEL`` a node holds the number of the label that ends there.
        self.spelled: dict = {}
        for label in known:
            node = self.spelled
            for byte in label:
                node = node.setdefault(byte, {})
            node[LABEL] = self.number[label]
        self.longest = max(map(len, known), default=0)

    def _number(self, known: dict, grown: dict[bytes, list[tuple[int, bytes]]]) -> None:
        """Numbers of the labels: those that grow out of a label stand just before it, in the order
        of their gadgets, so what grows from a rank on, and the label itself, is a run."""
        self.number: dict[bytes, int] = {}
        self.run_start: dict[bytes, tuple[list[int], list[int]]] = {}
        for root in (x for x in known if len(x) == 1):
            walk = [(root, 0)]
            while walk:
                label, i = walk.pop()
                ranks, firsts = self.run_start.setdefault(label, ([], []))
                if i < len(grown[label]):
                    rank, child = grown[label][i]
                    ranks.append(rank)
                    firsts.append(len(self.number))
                    walk += [(label, i + 1), (child, 0)]
                else:
                    self.number[label] = len(self.number)

    def _runs(self, cuts: list[tuple[bytes, int]]) -> tuple[list[int], list[int]]:
        """The runs of label numbers that a state lacks, apart and in order."""
        runs = []
        for label, rank in cuts:
            ranks, firsts = self.run_start[label]
            last = self.number[label]
            at = bisect_right(ranks, rank - 1)
            runs.append((firsts[at] if at < len(firsts) else last, last))
        starts: list[int] = []
        ends: list[int] = []
        for first, last in sorted(runs):
            if ends and first <= ends[-1] + 1:
                ends[-1] = max(ends[-1], last)
            else:
                starts.append(first)
                ends.append(last)
        return starts, ends

    def has_arc(self, state: bytes, label: bytes) -> bool:
        """Whether an arc with this label leaves the state that the label ``state`` leads to."""
        starts, ends = self.missing[self.number[state]]
        i = bisect_right(starts, self.number[label])
        return i == 0 or ends[i - 1] < self.number[label]

    def encode(self, word: bytes) -> list[int]:
        """The ids of the labels on the one path that spells the word."""
        n = len(word)
        reached = [-1] * (n + 1)
        before = [0] * (n + 1)
        missing, longest = self.missing, self.longest
        starts: list[int] = []
        ends: list[int] = []
        for at in range(n):
            if at:
                starts, ends = missing[reached[at]]
            node, end = self.spelled, at
            for byte in word[at : at + longest]:
                node = node.get(byte)
                if node is None:
                    break
                end += 1
                if LABEL in node and reached[end] < 0:
                    label = node[LABEL]
                    i = bisect_right(starts, label)
                    if i == 0 or ends[i - 1] < label:
                        reached[end], before[end] = label, at
            if end == at:
                raise ValueError("the vocabulary lacks a byte of the text")
        ids = []
        while n:
            ids.append(self.ids[reached[n]])
            n = before[n]
        return ids[::-1]


class Codec:
    """Ids of texts and texts of ids, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, rule = held["model"], held["pre_tokenizer"]
        plain = rule["type"] == "ByteLevel" and rule.get("use_regex", True) and not rule["add_prefix_space"]
        if not plain or held.get("normalizer") or held.get("post_processor") or model.get("ignore_merges"):
            raise ValueError("only byte-level vocabularies without normaliser are supported")
        added = held.get("added_tokens") or []
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        letters = byte_letters()
        spelled = {token: bytes(letters[c] for c in token) for token in model["vocab"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merges = [(spelled[u], spelled[v]) for u, v in pairs]
        self.automaton = Automaton({spelled[t]: i for t, i in model["vocab"].items()}, merges)
        self.added = {a["content"]: a["id"] for a in added}
        self.bytes_of = {i: spelled[t] for t, i in model["vocab"].items()}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        self.words = regex.compile(WORDS)
        self.ascii_words = re.compile(ASCII_WORDS, re.ASCII)
        self.cache: dict[str, list[int]] = {}

    def word_ids(self, word: str) -> list[int]:
        ids = self.automaton.encode(word.encode())
        if len(word) <= CACHED_LENGTH:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The ids of a text in blocks of some ``BLOCK_TOKENS``."""
        ids: list[int] = []
        at = 0
        while at <= len(text):
            mark = self.split.search(text, at) if self.split else None
            end = mark.start() if mark else len(text)
            for word in self._split(text, at, end):
                ids += self.cache.get(word) or self.word_ids(word)
                if len(ids) >= BLOCK_TOKENS:
                    yield ids
                    ids = []
            if mark is None:
                break
            ids.append(self.added[mark.group()])
            at = mark.end()
        yield ids

    def _split(self, text: str, at: int, end: int) -> Iterable[str]:
        """The words between two places; those of a long stretch one by one."""
        pattern = self.ascii_words if text.isascii() else self.words
        if end - at <= BLOCK_LETTERS:
            return pattern.findall(text, at, end)
        return (found.group() for found in pattern.finditer(text, at, end))

    def encode(self, text: str) -> list[int]:
        return [i for block in self.blocks(text) for i in block]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The arc labels end to end; ids that the vocabulary lacks give nothing."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process, used by all tasks that it runs."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Each document's token ids: ``doc_id`` and ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            ids = [own.encode(text or "") for text in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """Each document's text from its ``ids``; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            texts = [own.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text"])

    ship(tokens.sparkSession)
    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Each document's number of tokens and the checksums of its ids and of what they decode to.

    Ids and bytes pass in blocks, so a long text is never held as a list of all its tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            rows = [_digest(own, text or "") for text in batch.column("text").to_pylist()]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def _digest(own: Codec, text: str) -> tuple[int, str, str]:
    """Every byte of a text is on a label, so the blocks decode to its UTF-8 end to end."""
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
    for ids in own.blocks(text):
        n += len(ids)
        of_ids.update(np.array(ids, "<u4").tobytes())
        of_text.update(own.decode_bytes(ids))
    return n, of_ids.hexdigest(), of_text.hexdigest()
