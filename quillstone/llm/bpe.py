"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest vocabulary entries.  A cut is
the true BPE result exactly if every adjacent pair is compatible, that is, if
the pair's own text encodes to the pair again; this holds because merges have
a strict order, so a merge across a border would show in the two tokens next
to it.  All pairs of all new words of a batch are tested at once by NumPy;
only words with a failing pair are merged exactly, rule by rule.  Tokens
whose own text encodes otherwise are never proposed.

Nulls: a null text is empty: no tokens, decoded to the empty text.  Equal
rows give equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillstone.llm.arrowtext import slices

#: Cached words of a worker in each of two generations; results do not depend on it.
CACHED = 400_000
#: Words of more tokens merge through a heap, with the same result.
LONG = 64
#: Longer texts without blanks are not kept in the cache.
KEPT_LETTERS = 200
_BIG = np.int64(1) << np.int64(40)
_NEVER = 1 << 60
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordBPE:
    """A tokenizer file whose words end in a suffix: NFC, blanks joined, lower case, words found by a pattern."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or spec["decoder"] or model["byte_fallback"]:
            raise ValueError(f"{path}: not a tokenizer of the supported kind")
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.table = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {}
        left, right = {}, {}
        made = {}
        for k, (a, b) in enumerate(pairs):
            if a in self.vocab and b in self.vocab and a + b in self.vocab:
                self.rank.setdefault((a, b), k)
                made.setdefault(a + b, k)
                left.setdefault(a + b, a)
                right.setdefault(a + b, b)
        n = max(self.vocab.values()) + 1
        # per token id: the rank of its merge (-1: a letter) and its halves
        self.made = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        for t, k in made.items():
            i = self.vocab[t]
            self.made[i], self.left[i], self.right[i] = k, self.vocab[left[t]], self.vocab[right[t]]
        keys = np.array([(self.vocab[a] << 20) | self.vocab[b] for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        self.rules = {int(k): (r << 20) | self.vocab[a + b] for k, r, (a, b) in zip(keys, self.rank.values(), self.rank)}
        self.longest = max(map(len, self.vocab))
        self.sound = {t for t, i in self.vocab.items() if self.made[i] < 0 or self._self_encodes(t)}
        # the longest entry inside a word for each two letters that it may start with
        self.reach: dict[str, int] = {}
        for t in self.sound:
            if len(t) > 1 and not (self.suffix and t.endswith(self.suffix)):
                self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 0))
        self.known: dict[str, tuple[str, str, int]] = {}
        self.cache: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}

    def _self_encodes(self, token: str) -> bool:
        end = token.endswith(self.suffix) and bool(self.suffix)
        body = token[: len(token) - len(self.suffix)] if end else token
        symbols = [*body[:-1], body[-1] + self.suffix] if end else [*body]
        return self._merge(symbols) == [self.vocab[token]]

    def _merge(self, symbols: list[str]) -> list[int]:
        """Exact merging: the earliest rule that applies, at its first place, until none applies."""
        rules, vocab = self.rules, self.vocab
        ids = [vocab[x] for x in symbols if x in vocab]
        if len(ids) > LONG:
            return self._merge_long(ids)
        ranks = [rules.get(a << 20 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NEVER:
                break
            k = ranks.index(low)
            ids[k : k + 2] = [low & 0xFFFFF]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rules.get(ids[k] << 20 | ids[k + 1], _NEVER)
            if k:
                ranks[k - 1] = rules.get(ids[k - 1] << 20 | ids[k], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of rules and places and links between what is left."""
        rules, n = self.rules, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rule, k) for k in range(n - 1) if (rule := rules.get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rule, k = heapq.heappop(heap)
            right = after[k]
            # stale unless the pair at this place still has the rule
            if right < 0 or ids[k] < 0 or rules.get(ids[k] << 20 | ids[right]) != rule:
                continue
            ids[k], ids[right] = rule & 0xFFFFF, -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
                if (rule := rules.get(ids[k] << 20 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (rule, k))
            if before[k] >= 0 and (rule := rules.get(ids[before[k]] << 20 | ids[k])) is not None:
                heapq.heappush(heap, (rule, before[k]))
        return [i for i in ids if i >= 0]

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None where a letter is no vocabulary entry."""
        got, at, n = [], 0, len(word)
        vocab, sound, end = self.vocab, self.sound, word + self.suffix
        most = self.longest - len(self.suffix)
        while at < n:
            if n - at <= most and end[at:] in sound:
                got.append(vocab[end[at:]])
                break
            for to in range(min(n - 1, at + self.reach.get(word[at : at + 2], 1)), at, -1):
                if (t := word[at:to]) in sound:
                    got.append(vocab[t])
                    at = to
                    break
            else:
                return None
        return got

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of token ids: does their joined text encode to them again?

        Walks down the border: the letters left and right of it belong to
        ever smaller tokens.  A merge across the border wins if its rule comes
        before the rule that used up either neighbour.
        """
        ok = np.ones(len(a), bool)
        a, b = a.copy(), b.copy()
        # the rule that consumes the present left and right token; none so far
        until_a = np.full(len(a), _BIG)
        until_b = np.full(len(a), _BIG)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = (x << 20) | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _BIG)
            # inside the left token a merge of equal rank comes first (it lies to the left), inside the right one it does not
            wins = (rank < until_a[live]) & (rank <= until_b[live]) & (rank < _BIG)
            ok[live[wins]] = False
            down_a = self.made[x] >= self.made[y]
            done = (self.made[x] < 0) & (self.made[y] < 0)
            go = ~wins & ~done
            one, two = live[go & down_a], live[go & ~down_a]
            until_a[one] = self.made[a[one]]
            a[one] = self.right[a[one]]
            until_b[two] = self.made[b[two]]
            b[two] = self.left[b[two]]
            live = live[go]
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of words in byte letters."""
        got = [self.propose(w) for w in words]
        size = np.array([len(g) if g else 0 for g in got])
        flat = np.fromiter((i for g in got if g for i in g), np.int64, int(size.sum()))
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(size)[size > 0] - 1] = False
        at = np.flatnonzero(inner)
        keys, back = np.unique((flat[at] << 20) | flat[at + 1], return_inverse=True)
        fine = self._compatible(keys >> 20, keys & 0xFFFFF)[back]
        owner = np.repeat(np.arange(len(got)), size)[at]
        failed = np.zeros(len(got), bool)
        failed[owner[~fine]] = True
        for k, w in enumerate(words):
            if failed[k] or got[k] is None:
                got[k] = self._merge([*w[:-1], w[-1] + self.suffix])
        return got

    def _learn(self, chunks: list[str]) -> None:
        """Put texts without blanks into the cache."""
        if len(self.known) > CACHED:
            self.known = {}
        known, table, plan = self.known, self.table, []
        new: dict[str, None] = {}
        for c in chunks:
            if not c.isascii():
                c = unicodedata.normalize("NFC", c).replace("Σ", "σ")
            found = self.words.findall(c.lower())
            plan.append(found)
            for w in found:
                if w not in known:
                    new[w] = None
        words = list(new)
        shown = [w.encode().decode("latin-1").translate(table) for w in words]
        for w, own in zip(words, self.encode_words(shown) if words else []):
            known[w] = (" ".join(map(str, own)), " ".join(map(self.token.__getitem__, own)), len(own))
        for c, found in zip(chunks, plan):
            if len(found) == 1:
                self.cache[c] = known[found[0]]
            else:
                got = [known[w] for w in found]
                self.cache[c] = (" ".join([x[0] for x in got]), " ".join([x[1] for x in got]), sum([x[2] for x in got]))

    def _chunks(self, text: str) -> list[str]:
        return _BLANKS.split(text) if _ODD.search(text) else text.split()

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """For each text: decimal ids joined by blanks, decoded text, number of tokens."""
        if len(self.cache) > CACHED:
            self.cache, self.old = {}, self.cache
        plan: list[list[str]] = []
        new: dict[str, None] = {}
        cache, old = self.cache, self.old
        for text in texts:
            parts = self.split_added.split(text) if self.split_added and any(x in text for x in self.added) else [text]
            chunks: list[str] = []
            for k, part in enumerate(parts):
                if k & 1:
                    cache[part] = (str(self.added[part]), part, 1)
                    chunks.append(part)
                else:
                    chunks += self._chunks(part)
            plan.append(chunks)
            for c in chunks:
                if c not in cache:
                    if c in old:
                        cache[c] = old[c]
                    else:
                        new[c] = None
        missing = list(new)
        for k in range(0, len(missing), 20_000):
            self._learn(missing[k : k + 20_000])
        out = []
        for chunks in plan:
            found = [x for x in map(cache.__getitem__, chunks) if x[2]]
            out.append((" ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])))
        for c in missing:
            if len(c) > KEPT_LETTERS:
                del self.cache[c]
        for w in [w for w in self.known if len(w) > KEPT_LETTERS] if any(len(c) > KEPT_LETTERS for c in missing) else ():
            del self.known[w]
        return out


@cache
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, path: str, text_out: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row's text; ``ids`` and ``decoded`` too with ``text_out``."""

    def run(batches):
        for batch in slices(batches, "text", 2_000_000):
            got = word_bpe(path).encode_batch([x or "" for x in batch.column(1).to_pylist()])
            columns = [
                batch.column(0),
                pa.array([x[2] for x in got], pa.int64()),
                pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in got]),
                pa.array([hashlib.sha256(x[1].encode()).hexdigest() for x in got]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if text_out:
                columns += [pa.array([[*map(int, x[0].split())] for x in got], pa.list_(pa.int64())), pa.array([x[1] for x in got])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<long>, decoded string" if text_out else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
