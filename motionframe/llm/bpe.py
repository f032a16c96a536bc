"""Byte-level BPE by a prefix-sharing walk over the trie of distinct words.

A byte string is the BPE encoding ``t1 .. tn`` exactly when every neighbouring
pair ``(ti, ti+1)`` is *stable*: the two tokens' bytes together encode to those
same two tokens. So the encoding of a string is known from the last token of
each of its prefixes, and the last token of a prefix depends only on shorter
prefixes: it is the one vocabulary entry that ends the prefix and forms a stable
pair with the last token of what stands before it. Walking the trie of distinct
words depth-first computes that state once for every shared prefix.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .storage import id_and_text

VOCABULARY = "byte_bpe_50k.json"
#: How the byte-level pre-tokenizer cuts a text into words.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words kept between batches by one worker, and words walked at once.
CACHE_WORDS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, their merge ranks, and the added (special) tokens of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        self.merge = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merge[self.id_of[left], self.id_of[right]] = (rank, self.id_of[left + right])
        self.longest = max(map(len, self.id_of))

    def by_merging(self, text: bytes) -> list[int]:
        """The encoding by repeated lowest-rank merges: quadratic, used on pairs of tokens only."""
        ids = [self.id_of[text[i : i + 1]] for i in range(len(text))]
        while len(ids) > 1:
            rank, at = min(((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=(0, -1))
            if at < 0:
                break
            pair = (ids[at], ids[at + 1])
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(self.merge[pair][1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


class TrieEncoder:
    """Encodes sets of distinct words; keeps which token pairs are stable between calls."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.stable: dict[int, bool] = {}
        self.whole = {t: v for t, v in vocabulary.id_of.items() if vocabulary.by_merging(t) == [v]}

    def is_stable(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.stable.get(key)
        if known is None:
            v = self.vocabulary
            if len(self.stable) >= 4_000_000:
                self.stable.clear()
            known = self.stable[key] = v.by_merging(v.bytes_of[left] + v.bytes_of[right]) == [left, right]
        return known

    def encode(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its ids.

        Sorted words are the trie in depth-first order: a word's path shares with its predecessor's the
        nodes of their common prefix, whose last-token states stay on the stack; the rest are new nodes.
        """
        whole, stable, longest = self.whole, self.is_stable, self.vocabulary.longest
        size = {i: len(t) for t, i in whole.items()}
        last: list[int] = []  # the stack: the last token of each prefix of the current word
        before = b""
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n, len(before))
            if word[: len(before)] == before:
                shared = len(before)
            else:
                while shared < most and word[shared] == before[shared]:
                    shared += 1
            del last[shared:]
            for end in range(shared + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    token = whole.get(word[start:end])
                    if token is not None and (start == 0 or stable(last[start - 1], token)):
                        last.append(token)
                        break
            before = word
            ids, end = [], n
            while end:
                token = last[end - 1]
                ids.append(token)
                end -= size[token]
            ids.reverse()
            yield word, ids


class Codec:
    """Texts to ids and back, one word at a time through a bounded cache of distinct words."""

    def __init__(self, path: str, encoder: bool = True):
        import regex

        self.vocabulary = Vocabulary(path)
        self.encoder = TrieEncoder(self.vocabulary) if encoder else None
        self.words = regex.compile(WORD)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None
        self.known: dict[str, tuple[str, bytes]] = {}

    def split(self, text: str) -> list[str]:
        """The text's words in order; an added token is a word of its own, and texts are cut around it first."""
        if self.special is None or not self.special.search(text):
            return self.words.findall(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.words.findall(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet. Forgets all others first when the cache is full."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = {w.encode(): w for w in words if w not in known}
        for word, token in self.vocabulary.special.items():
            if new.pop(word.encode(), None) is not None:
                known[word] = (str(token), word.encode())
        bytes_of = self.vocabulary.bytes_of
        for raw, ids in self.encoder.encode(new):
            known[new[raw]] = (",".join(map(str, ids)), b"".join([bytes_of[i] for i in ids]))

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.known[w][0].split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        names = {i: w.encode() for w, i in self.vocabulary.special.items()}
        return b"".join(names.get(i) or self.vocabulary.bytes_of[i] for i in ids).decode("utf-8", "replace")


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, encoder: bool = True) -> Codec:
    """One per worker process and vocabulary file; without ``encoder`` it only holds the vocabulary and the cuts."""
    if (path, encoder) not in _codecs:
        _codecs[path, encoder] = Codec(path, encoder)
    return _codecs[path, encoder]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids array<int>``, ``decoded`` with ``with_ids``), one row per input row.

    Map-only: every Arrow batch's distinct words form a trie that is walked once, words already met by the
    worker are reused, and no row leaves its partition. Null and empty texts have no tokens; repeated rows
    are encoded each; extra columns are ignored; an empty table gives no rows. A text of any length is
    encoded whole. Words longer than the longest token cost time linear in their length.
    """
    path = vocabulary or os.path.abspath(default_vocabulary())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        for batch in batches:
            rows = []
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                split = [coder.split(t) for t in part["text"]]
                distinct: set[str] = set()
                distinct.update(*split)
                coder.learn(distinct)
                known = coder.known
                for doc_id, words in zip(part["doc_id"], split):
                    found = [known[w] for w in words]
                    ids = ",".join([x[0] for x in found])
                    decoded = b"".join([x[1] for x in found]).decode("utf-8", "replace")
                    row = (doc_id, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append(row + ([int(i) for i in ids.split(",")] if ids else [], decoded) if with_ids else row)
            names = [c.split(" ")[0] for c in schema.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return id_and_text(docs).mapInPandas(run, schema)
