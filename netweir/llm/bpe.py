"""BPE encoding and decoding: speculate by greedy longest match, verify adjacent pairs, merge exactly where that fails.

A token sequence is the BPE encoding of a word when each token is the encoding of its own bytes and each adjacent
pair of tokens is the encoding of that pair's bytes.  So a word's greedy longest-match proposal is checked pair by pair,
all new pairs of a batch at once in numpy; only words with an incompatible pair go through the merge loop.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, strings

#: Bytes of cached words (as many of older ones beside them), cached pairs, the longest word that is cached and merged in the plain way; characters taken at once.
WORD_BYTES, PAIR_CACHE, LONG_WORD, PIECE = 40 << 20, 200_000, 64, 1 << 20
#: About what a cached word takes beside its characters and tokens.
ENTRY = 200
#: The pre-tokeniser's pattern that byte-level BPE files of this kind imply.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts whose characters are all ASCII, but for U+001C to U+001F, or Latin-1 letters; for these texts re's classes
#: and Unicode's agree, and re is faster.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
SIMPLE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
BEYOND = rf"[^\x00-\x1b\x20-\x7f{LETTERS}]"
#: Above every merge rank.
NEVER = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: printable Latin-1 as itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Codec:
    """A byte-level BPE vocabulary file with its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.byte_ids = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.merge: dict[tuple[int, int], int] = {}
        self.formed: list[int] = []
        rank = np.full(size, -1, np.int64)
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = raw(a), raw(b)
            i, j, to = self.ids[x], self.ids[y], self.ids[x + y]
            self.merge[i, j] = k
            self.formed.append(to)
            if rank[to] < 0:
                rank[to], left[to], right[to] = k, i, j
        self.rank, self.left, self.right = rank, left, right
        keys = np.array([i * size + j for i, j in self.merge], np.int64)
        ranks = np.array(list(self.merge.values()), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.size = keys[order], ranks[order], size
        # Byte tokens stand for themselves; another token must be what its own bytes merge to, or it is never proposed.
        self.match = {b: i for b, i in self.ids.items() if len(b) == 1 or self.merged(b) == [i]}
        # Tokens by their bytes, and all beginnings of tokens, which say how far a longer one may be looked for.
        self.begins = {b[:k] for b in self.match for k in range(2, len(b))}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.pairs: dict[int, bool] = {}
        self.pattern, self.simple, self.beyond = regex.compile(PATTERN), re.compile(SIMPLE), re.compile(BEYOND)
        self.cuts = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """Exact encoding of one word: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        if len(word) > LONG_WORD:
            return self.merged_long(word)
        ids, rank_of, to, none = self.byte_ids, self.merge.get, self.formed, len(self.formed)
        out = [ids[b] for b in word]
        ranks = [rank_of(p, none) for p in zip(out, out[1:])]
        while ranks and (low := min(ranks)) < none:
            k = ranks.index(low)
            out[k] = to[low]
            del out[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank_of((out[k - 1], out[k]), none)
            if k < len(ranks):
                ranks[k] = rank_of((out[k], out[k + 1]), none)
        return out

    def merged_long(self, word: bytes) -> list[int]:
        """As merged(), in O(n log n): a heap of pairs over a linked list."""
        out: list[int] = [self.byte_ids[b] for b in word]
        n = len(out)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merge[p], k) for k, p in enumerate(zip(out, out[1:])) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            low, k = heapq.heappop(heap)
            j = after[k] if out[k] >= 0 else n
            if j >= n or self.merge.get((out[k], out[j])) != low:
                continue
            out[k], out[j] = self.formed[low], -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
                if (r := self.merge.get((out[k], out[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := self.merge.get((out[before[k]], out[k]))) is not None:
                heapq.heappush(heap, (r, before[k]))
        return [x for x in out if x >= 0]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        match, begins = self.match, self.begins
        if (i := match.get(word)) is not None:
            return [i]
        out, k, n = [], 0, len(word)
        while k < n:
            end = k + 1
            found = match[word[k:end]]
            j = k + 2
            while j <= n:
                piece = word[k:j]
                if (i := match.get(piece)) is not None:
                    found, end = i, j
                elif piece not in begins:
                    break
                if piece not in begins:
                    break
                j += 1
            out.append(found)
            k = end
        return out

    def combined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; NEVER where the pair does not merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether their bytes together encode to just this pair.

        Undo both tokens' merges in the order of falling rank, the later one first.  If the pieces that touch at the
        border would themselves have merged before the later piece was formed, the pair is not stable.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit, tie = np.full(len(a), NEVER), np.zeros(len(a), bool)
        while len(live):
            r = self.combined(a, b)
            # tie: a merge of equal rank to the left of the border goes first, one to its right goes after
            bad = (r < limit) | ((r == limit) & tie & (r < NEVER))
            good[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            keep = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[keep], a[keep], b[keep], ra[keep], rb[keep]
            undo_left = ra > rb
            # Of two halves with the same rank the left one merges first, so the right one is undone first.
            limit, tie = np.where(undo_left, ra, rb), ~undo_left
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def learn(self, new: list[str]) -> dict[str, tuple[int, ...]]:
        """Encode words."""
        if len(self.pairs) > PAIR_CACHE:
            self.pairs.clear()
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        guess = [self.proposed(w) for w in raw]
        size, pairs = self.size, self.pairs
        todo = list({k for g in guess for k in (x * size + y for x, y in zip(g, g[1:])) if k not in pairs})
        if todo:
            keys = np.array(todo, np.int64)
            pairs.update(zip(todo, self.compatible(keys // size, keys % size).tolist()))
        return {w: tuple(g if all(pairs[x * size + y] for x, y in zip(g, g[1:])) else self.merged(b)) for w, b, g in zip(new, raw, guess)}

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text; strings of special tokens in a text are those tokens."""
        out, i = [], 0
        while i < len(texts):  # about PIECE characters at once, one text at least
            j, size = i + 1, len(texts[i])
            while j < len(texts) and size + len(texts[j]) <= PIECE:
                size += len(texts[j])
                j += 1
            out += self.encode_some(texts[i:j])
            i = j
        return out

    def encode_some(self, texts: list[str]) -> list[list[int]]:
        split = []
        for t in texts:
            sections = self.cuts.split(t) if self.cuts else [t]
            words_in = (self.pattern if self.beyond.search(t) else self.simple).findall
            split.append([s if k % 2 else words_in(s) for k, s in enumerate(sections)])
        here = {w for s in split for x in s if not isinstance(x, str) for w in x}
        new = list(here.difference(self.words))
        if self.held > WORD_BYTES:  # words that were not used since the last time go
            self.older, self.words, self.held = self.words, {}, 0
            new = list(here)
        words, older, long = self.words, self.older, []
        if new:
            words.update({w: x for w in new if (x := older.get(w)) is not None})
            words.update(self.learn([w for w in new if w not in older]))
            long = [w for w in new if len(w) > LONG_WORD]
            self.held += sum(ENTRY + len(w) + 8 * len(words[w]) for w in new)
        out = []
        for s in split:
            ids: list[int] = []
            for x in s:
                if isinstance(x, str):
                    ids.append(self.special[x])
                else:
                    for w in x:
                        ids.extend(words[w])
            out.append(ids)
        for w in long:  # one such word can be as long as a text
            self.held -= ENTRY + len(w) + 8 * len(words.pop(w))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; bytes that are no UTF-8 become U+FFFD."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<int>) for every row; ``path`` names a vocabulary file that every worker has.

    Null and empty texts give no tokens.  Texts of any length are encoded whole, in pieces that the pre-tokeniser makes;
    null ids and repeated rows are passed on, one row out for each row in; other columns are not looked at.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(path).encode_all(strings(b, "text"))
        return pa.record_batch([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, n_tokens bigint, ids array<int>", 500).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row of ids; null ids arrays give the empty text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        return pa.record_batch([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return map_arrow(tokens.select(tokens[id_col].alias("id"), tokens[ids_col].alias("ids")), run, f"id {kind}, text string", 500).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode every text in one pass, keeping digests only."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = c.encode_all(strings(b, "text"))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.record_batch(
            [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(np.array(x, "<u4").tobytes()) for x in ids]), pa.array([sha(c.decode(x).encode("utf-8", "surrogatepass")) for x in ids])],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", 500).withColumnRenamed("id", id_col)
