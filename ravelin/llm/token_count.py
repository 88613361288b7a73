"""Token counts by rank-synchronous array merging.

The counts are those of the sentencepiece library for a BPE model with byte fallback. A text is cut
into pre-tokens where no vocabulary entry can reach across (before a run of word marks, and around
characters outside the vocabulary). The distinct pre-tokens of a batch are held as ragged arrays: one
flat symbol array with segment ids. In each round every live sequence applies its lowest-rank pair at
the same time, and the loop ends when no sequence has a pair left; the surviving symbols are the count.

Of equal pairs in one sequence the library merges the leftmost first. All occurrences are merged in
one round when no pair that could arise next to a merged symbol ranks lower, so that the order cannot
matter; else only the leftmost is merged. Characters outside the vocabulary count as their UTF-8 bytes.

Defined cases: a null text is empty and has no token; special strings inside a text are ordinary text;
repeated ids give a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, text_of, trim

MARK = "▁"
#: Distinct pre-tokens that a worker remembers; the memory is emptied when it is full.
MEMO = 600_000
#: Symbols merged at once; a longer pre-token makes a batch of its own.
BATCH = 1_000_000
NO_RANK = np.iinfo(np.int64).max


class Merger:
    """Vocabulary of a BPE model as sorted arrays: pair of symbols -> (rank, merged symbol)."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        plain = [
            (m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())
            if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))
        ]
        chars = sorted({c for p, _ in plain for c in p})
        symbols = {c: i + 1 for i, c in enumerate(chars)}
        for p, _ in plain:
            symbols.setdefault(p, len(symbols) + 1)
        whole = {p for p, _ in plain}
        #: A single character that is no entry of its own still joins pairs, but falls back to bytes.
        self.chars = {c: symbols[c] for c in chars}
        self.loose = {c for c in chars if c not in whole}
        order = sorted({s for p, s in plain if len(p) > 1}, reverse=True)
        place = {s: i for i, s in enumerate(order)}
        self.base = len(symbols) + 1
        pairs = [
            (symbols[p[:k]] * self.base + symbols[p[k:]], place[s], symbols[p])
            for p, s in plain for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols
        ]
        self.keys, self.ranks, self.results = self._hashed(np.array(sorted(pairs), dtype=np.int64).reshape(-1, 3))
        #: Symbol of each code point, 0 outside the vocabulary.
        self.code_points = np.zeros(0x110000, np.int64)
        for c, symbol in self.chars.items():
            self.code_points[ord(c)] = symbol
        #: Pre-tokens: a run of marks with what follows up to the next mark.
        self.pieces = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.memo: dict[str, int] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hashed(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Open addressing, filled at most to a quarter; a key of 0 is an empty slot."""
        self.bits = max(8, int(len(table) * 4).bit_length())
        size = 1 << self.bits
        keys, ranks, results = np.zeros(size, np.int64), np.full(size, NO_RANK), np.zeros(size, np.int64)
        rest, at = np.arange(len(table)), self._slot(table[:, 0].copy())
        while len(rest):
            free = keys[at] == 0
            keys[at[free]] = table[rest[free], 0]
            placed = keys[at] == table[rest, 0]
            ranks[at[placed]], results[at[placed]] = table[rest[placed], 1], table[rest[placed], 2]
            rest, at = rest[~placed], (at[~placed] + 1) & (size - 1)
        return keys, ranks, results

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair, NO_RANK where the vocabulary has none; symbol 0 never pairs."""
        key = np.where((left > 0) & (right > 0), left * self.base + right, 0)
        at = self._slot(key)
        found = self.keys[at]
        rest = np.flatnonzero((found != key) & (found != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            found[rest] = self.keys[at[rest]]
            rest = rest[(found[rest] != key[rest]) & (found[rest] != 0)]
        hit = (found == key) & (key != 0)
        return np.where(hit, self.ranks[at], NO_RANK), np.where(hit, self.results[at], 0)

    def survivors(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge all sequences to the end; the symbols that are left and their owners.

        ``rank`` and ``merged`` hold for each symbol its pair with the next one; after a round only the
        pairs beside merged symbols are looked up again.
        """
        done_symbols, done_owner = [], []
        rank, merged = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int64)
        stale = np.arange(len(symbols))
        while len(symbols):
            stale = stale[stale + 1 < len(symbols)]
            r, m = self.rank(symbols[stale], symbols[stale + 1])
            r[owner[stale] != owner[stale + 1]] = NO_RANK
            rank[stale], merged[stale], rank[-1] = r, m, NO_RANK
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            level = np.repeat(lowest, sizes)
            live = level < NO_RANK
            if not live.all():  # finished sequences leave the arrays
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, rank, merged, level = symbols[live], owner[live], rank[live], merged[live], level[live]
                if not len(symbols):
                    break
            pick = self._chosen(symbols, owner, rank, merged, level)
            symbols[pick] = merged[pick]
            keep = np.ones(len(symbols), bool)
            keep[pick + 1] = False
            moved = np.cumsum(keep) - 1
            stale = moved[pick]
            symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
            near = np.zeros(len(symbols), bool)
            near[stale] = near[np.maximum(stale - 1, 0)] = True
            stale = np.flatnonzero(near)
        return np.concatenate([*done_symbols, symbols]), np.concatenate([*done_owner, owner])

    def _chosen(self, symbols, owner, rank, merged, level) -> np.ndarray:
        """Left ends of the pairs that merge now: all of the lowest rank where the order can't matter."""
        at = np.flatnonzero(rank == level)
        # of overlapping occurrences (aaa) every second one from the left of its run goes
        begins = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
        if first.all():
            return at
        new, own, last = merged[at], rank[at], len(symbols) - 1
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, last)
        after_merge = np.full(len(symbols), -1)
        after_merge[at] = new
        before_merged = np.where(at >= 2, after_merge[np.maximum(at - 2, 0)], -1)
        risky = np.zeros(len(at), bool)
        for other, place, is_left in (
            (symbols[before], before, True), (before_merged, before, True),
            (symbols[after], after, False), (after_merge[after], after, False),
        ):
            valid = (owner[place] == owner[at]) & (other > 0) & ((at >= 1) if is_left else (at + 2 <= last))
            r, _ = self.rank(other, new) if is_left else self.rank(new, other)
            risky |= valid & (r < own)
        bad = np.zeros(int(owner.max()) + 1, bool)
        bad[owner[at[risky]]] = True
        return at[first | ~bad[owner[at]]]

    def learn(self, pieces: list[str]) -> None:
        """Count the pre-tokens in batches of ragged arrays and remember the counts."""
        start = 0
        while start < len(pieces):
            end, size = start, 0
            while end < len(pieces) and (end == start or size + len(pieces[end]) <= BATCH):
                size += len(pieces[end])
                end += 1
            self._learn(pieces[start:end])
            start = end

    def _learn(self, pieces: list[str]) -> None:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        text = "".join(pieces)
        symbols = self.code_points[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        counts = np.zeros(len(pieces), np.int64)
        outside = np.flatnonzero(symbols == 0)
        np.add.at(counts, owner[outside], [len(text[i].encode("utf-8", "surrogatepass")) for i in outside])
        left, of = self.survivors(symbols, owner, len(pieces))
        counts += np.bincount(of[left > 0], minlength=len(pieces))
        for c in self.loose:
            hit = of[left == self.chars[c]]
            np.add.at(counts, hit, len(c.encode()) - 1)
        self.memo.update(zip(pieces, counts.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        cut, memo = [], self.memo
        if len(memo) > MEMO:
            memo.clear()
        for t in texts:
            # an unknown character is a barrier for merges: a line break is the common one
            t = self.model.normalize(t) if t else ""
            cut.append([p for line in t.split("\n") for p in self.pieces.findall(line)] if "\n" not in self.chars else self.pieces.findall(t))
        missing = {p for pieces in cut for p in pieces if p not in memo}
        if missing:
            self.learn(list(missing))
        breaks = 0 if "\n" in self.chars else 1
        get = memo.__getitem__
        return [sum(map(get, pieces)) + breaks * t.count("\n") for pieces, t in zip(cut, texts, strict=True)]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


#: Texts merged together; bounded by characters as well.
TEXTS, CHARS = 512, 4_000_000


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if i + 1 - start >= TEXTS or size >= CHARS or i + 1 == len(texts):
            yield start, i + 1
            start, size = i + 1, 0


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; ``path`` is a BPE model file."""
    lean(docs.sparkSession)
    rows = docs.select("doc_id", text_of().alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        own = merger(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            tokens = [n for i, j in slices(texts) for n in own.count(texts[i:j])]
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
