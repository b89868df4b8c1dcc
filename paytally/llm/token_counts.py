"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous merging.

The distinct unknown pre-tokens of a batch lie in one ragged numpy array of symbols. Each round finds
every sequence's lowest-ranked pair, merges all its places in all sequences at once, closes the gaps
and looks up the ranks of the changed pairs only; sequences without a known pair leave with the number
of symbols they have left. The counts of words and pre-tokens are remembered by the task's process
and reused by the texts that follow. One Python step, no shuffle: tasks are independent.

Null and empty texts have 0 bytes and 0 tokens; repeated rows and ids are counted row by row; other
columns are not read. A text of any length is counted whole: words go to the merge step in parts of
a bounded number of symbols.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paytally.llm.common import per_batch

_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
)
_NO_RANK = np.int32(2**31 - 1)
# Normalising leaves these characters alone but for lower case, and all Unicode versions agree on them.
_PLAIN = re.compile("[!-~¡-¬®-ÿ]+")


class Merges:
    """A merge table as arrays: pairs of symbols to ranks, ranks to merged symbols."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        alphabet = _byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        self.size = max(vocab.values()) + 1
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # Merging all places of the lowest pair equals merging them one by one only if
        # no symbol can take part in a merge of a lower rank than the one that made it.
        made = np.full(self.size, -1)
        np.maximum.at(made, self.merged, np.arange(len(pairs)))
        if (np.maximum(made[left], made[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a symbol that a later merge makes")
        bits = max(4, (4 * len(pairs)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, _NO_RANK, np.int32)
        self._fill(left * self.size + right)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> None:
        rank, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(rank):  # each round the pairs that found a free slot settle, the rest move on by one
            free = self._keys[at] == -1
            slots, firsts = np.unique(at[free], return_index=True)
            settled = np.flatnonzero(free)[firsts]
            self._keys[slots], self._ranks[slots] = keys[rank[settled]], rank[settled]
            rest = np.ones(len(rank), bool)
            rest[settled] = False
            rank, at = rank[rest], (at[rest] + 1) & self._mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = self._home(keys)
        found = np.full(len(keys), _NO_RANK, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self._keys[at]
            hit = there == keys[open_]
            found[open_[hit]] = self._ranks[at[hit]]
            on = (there != -1) & ~hit
            open_, at = open_[on], (at[on] + 1) & self._mask
        return found

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) piece after all merges."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.first[flat]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        left = lengths.copy()
        who = np.arange(len(pieces))
        ranks = np.full(len(symbols), _NO_RANK, np.int32)
        ranks[:-1] = self.ranks(symbols[:-1], symbols[1:])
        ranks[ends - 1] = _NO_RANK
        while len(who):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(ranks, starts)
            live = lowest != _NO_RANK
            if not live.all():  # finished sequences leave
                left[who[~live]] = lengths[~live]
                keep = np.repeat(live, lengths)
                symbols, ranks = symbols[keep], ranks[keep]
                who, lengths, lowest = who[live], lengths[live], lowest[live]
                if not len(who):
                    break
            hit = ranks == np.repeat(lowest, lengths)
            at = np.flatnonzero(hit)
            # Overlapping places (a a a): within a run of neighbours every second one merges.
            opens = np.r_[True, np.diff(at) != 1]
            run = np.flatnonzero(opens)[np.cumsum(opens) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            owner = np.repeat(np.arange(len(who)), lengths)
            lengths = lengths - np.bincount(owner[at], minlength=len(who))
            # The merged symbol's pair with its right neighbour, and its left neighbour's pair with it.
            new = np.cumsum(keep)[at] - 1
            symbols, ranks = symbols[keep], ranks[keep]
            last = np.cumsum(lengths) - 1
            is_last = np.zeros(len(symbols), bool)
            is_last[last] = True
            changed = np.concatenate([new, new[new > 0] - 1])
            changed = changed[~is_last[changed]]
            ranks[changed] = self.ranks(symbols[changed], symbols[changed + 1])
            ranks[last] = _NO_RANK
        return left


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    kept = set(shown)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Counter:
    """Token counts of texts as a tokenizer file's library gives them, without added begin or end."""

    def __init__(self, path: str, most_words: int = 300_000, most_symbols: int = 2_000_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cutter = spec["model"], spec["pre_tokenizer"]
        steps = cutter.get("pretokenizers", [cutter])
        if (
            model["type"] != "BPE" or steps[-1]["type"] != "ByteLevel" or steps[-1]["use_regex"]
            or steps[-1]["add_prefix_space"] or len(steps) != 2 or steps[0]["type"] != "Split"
            or not steps[0]["invert"] or steps[0]["behavior"] != "Removed" or model.get("continuing_subword_prefix")
            or model.get("ignore_merges") or spec["truncation"] or spec["padding"]
            or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        ):
            raise ValueError(f"{path}: only byte-level BPE over pre-tokens that leave out white space is supported")
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"])
        self.library = Tokenizer.from_file(path)
        self.bytes_of = {c: b for b, c in enumerate(_byte_alphabet())}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.most_words, self.most_symbols = most_words, most_symbols
        self.words: dict[bytes, int] = {}
        self.known: dict[bytes, int] = {}

    _shared: dict[str, Counter] = {}

    @classmethod
    def shared(cls, path: str) -> Counter:
        """The process's counter for a file: tasks that follow each other share its memory."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _cut(self, word: bytes) -> list[bytes]:
        """A word without white space as its pre-tokens."""
        text = word.decode()
        if _PLAIN.fullmatch(text):
            return [p.encode() for p in self.pieces.findall(text.lower())]
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, piece)) for piece, _ in cut]

    def _learn(self, missing: set[bytes]) -> None:
        if len(self.words) + len(missing) > self.most_words:
            self.words.clear()
        if len(self.known) > self.most_words:
            self.known.clear()
        cut = {word: self._cut(word) for word in missing}
        new = {piece for pieces in cut.values() for piece in pieces}.difference(self.known)
        part, symbols = [], 0
        for piece in new:
            part.append(piece)
            symbols += len(piece)
            if symbols >= self.most_symbols:
                self.known.update(zip(part, self.merges.counts(part).tolist()))
                part, symbols = [], 0
        if part:
            self.known.update(zip(part, self.merges.counts(part).tolist()))
        self.words.update((word, sum(map(self.known.__getitem__, pieces))) for word, pieces in cut.items())

    def count(self, some: list[str | None], most_chars: int = 4_000_000) -> list[int]:
        """Tokens of each text. A text's tokens are those of its words: none reaches over white space."""
        counts, start, held = [], 0, 0
        for i, text in enumerate(some):
            held += len(text or "")
            if held >= most_chars or i + 1 == len(some):
                counts += self._count(some[start : i + 1])
                start, held = i + 1, 0
        return counts

    def _count(self, some: list[str | None]) -> list[int]:
        lists, added = [], []
        for text in some:
            n = 0
            if text and self.special and self.special.search(text):
                n = len(self.special.findall(text))
                text = self.special.sub(" ", text)
            added.append(n)
            lists.append((text or "").encode().lower().split())  # the tokenizer lowers A-Z as well
        missing = set().union(*lists).difference(self.words)
        if missing:
            held = set().union(*lists) if len(self.words) + len(missing) > self.most_words else missing
            self._learn(held)
        words = self.words.__getitem__
        return [n + sum(map(words, split)) for n, split in zip(added, lists)]


def count(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, UTF-8 bytes and tokens of the text, and whether the tokens exceed ``limit``."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        n_tokens = Counter.shared(tokenizer).count(batch["text"])
        return {
            "doc_id": batch["doc_id"],
            "n_bytes": [len((t or "").encode()) for t in batch["text"]],
            "n_tokens": n_tokens,
            "over_limit": [n > limit for n in n_tokens],
        }

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(per_batch(run, _SCHEMA), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
