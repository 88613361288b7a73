"""Benchmark decontamination by greedy string tiling.

Seeds are runs of MATCH words that a document shares with a benchmark item; they come from one table of
the items' run hashes. A pair goes on only if its seeds could cover enough of the item. For such a pair the
longest match of unmarked words is marked again and again, found by Karp-Rabin hashes of falling search
lengths and confirmed word by word, until no match of MATCH words is left. A pair is contaminated when the
marked tiles cover at least COVERAGE of the item's words, wherever and in whatever order they stand in the
document.

Words are maximal runs of letters and digits, lower-cased. A benchmark of at most BROADCAST characters goes
to every task with its seeds; the documents are then scanned once and nothing is shuffled. A larger one
stays distributed: its seeds are joined with those of the documents, and only pairs with enough of them
bring their two texts together. Both ways give the same rows.

Defined cases: a null text is empty and matches nothing; an item with fewer words than MATCH needs its
whole text as one match; items without words match nothing; repeated ids give their rows again; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, text_of, trim, without

MATCH, COVERAGE = 5, 0.5
#: Characters of the items up to which they are broadcast.
BROADCAST = 16_000_000
WORD = re.compile(r"[^\W_]+")
PRIME, BASE = (1 << 61) - 1, 911_382_323


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows; the multiplier is odd."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        out ^= out >> np.uint64(31)
    return out


def rolling(tokens: list[int], size: int, free: list[bool]) -> Iterator[tuple[int, int]]:
    """(place, Karp-Rabin hash) of each window of unmarked tokens, rolled on by one token at a time."""
    top = pow(BASE, size - 1, PRIME)
    value = run = 0
    for i, t in enumerate(tokens):
        if not free[i]:
            value = run = 0
            continue
        if run >= size:
            value = (value - tokens[i - size] * top) % PRIME
        value = (value * BASE + t) % PRIME
        run += 1
        if run >= size:
            yield i - size + 1, value


def tile(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of all tiles, longest first.

    Token 0 of the document matches nothing.
    """
    free_doc, free_item, tiles = [t != 0 for t in doc], [True] * len(item), []
    size = min(len(item), len(doc))
    while size >= least:
        table = defaultdict(list)
        for i, h in rolling(item, size, free_item):
            table[h].append(i)
        longest, found = size, []
        for j, h in rolling(doc, size, free_doc) if table else ():
            for i in table.get(h, ()):
                if i and j and free_item[i - 1] and free_doc[j - 1] and doc[j - 1] == item[i - 1]:
                    continue  # a part of the longer match that begins one word earlier
                if doc[j : j + size] == item[i : i + size]:
                    n = size
                    while j + n < len(doc) and i + n < len(item) and doc[j + n] == item[i + n] and free_doc[j + n] and free_item[i + n]:
                        n += 1
                    longest = max(longest, n)
                    found.append((n, j, i))
        for n, j, i in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if n == longest and all(free_doc[j : j + n]) and all(free_item[i : i + n]):
                free_doc[j : j + n], free_item[i : i + n] = [False] * n, [False] * n
                tiles.append((j, i, n))
        if not any(n < longest for n, _, _ in found):
            size = next_size(size, least)
    return tiles


def next_size(size: int, least: int) -> int:
    """Search lengths fall by halves to the least one; every match at one length is found whole there."""
    return least if size > least and size // 2 < least else (size // 2 if size > least else least - 1)


def grouped(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each stands there."""
    return np.unique(found, return_counts=True)


class Items:
    """Items: word numbers, and their run hashes in one sorted table of (hash, item, places of it there)."""

    def __init__(self, rows: list[tuple[object, str]], match: int) -> None:
        self.ids, self.vocabulary, self.tokens = [r[0] for r in rows], {}, []
        for _, text in rows:
            self.tokens.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)])
        self.mix = np.random.default_rng(11).integers(1, 1 << 63, len(self.vocabulary) + 1).astype(np.uint64)
        self.mix[0] = 0
        self.least = [min(match, len(t)) for t in self.tokens]
        self.tables = {}
        for size in sorted({n for n in self.least if n}):
            of = [k for k, n in enumerate(self.least) if n == size]
            each = [grouped(windows(self.mix[self.tokens[k]], size)) for k in of]
            hashes, places = (np.concatenate(x) for x in zip(*each, strict=True))
            items = np.repeat(of, [len(h) for h, _ in each])
            order = np.argsort(hashes, kind="stable")
            self.tables[size] = hashes[order], items[order], places[order]

    def matches(self, text: str, coverage: float) -> list[tuple[int, float, int, int]]:
        """(item number, coverage, tiles, longest tile) of the contaminated pairs."""
        numbers = np.fromiter((self.vocabulary.get(w, 0) for w in words(text)), np.int64)
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        within: dict[int, int] = defaultdict(int)
        for size, (hashes, of, places) in self.tables.items():
            here = windows(self.mix[numbers], size)
            if len(here):
                known = np.convolve(numbers == 0, np.ones(size, int), "valid") == 0
                at = np.flatnonzero(known)
                low, high = np.searchsorted(hashes, here[at], "left"), np.searchsorted(hashes, here[at], "right")
                hit = high > low
                for a, b in {*zip(low[hit].tolist(), high[hit].tolist(), strict=True)}:
                    for k, n in zip(of[a:b].tolist(), places[a:b].tolist(), strict=True):
                        within[k] += n
                # a run of ``size`` words that is no seed covers nothing, so only these items can be covered enough
                able = {k for k, n in within.items() if self.least[k] == size and n * size >= coverage * len(self.tokens[k])}
                for j, a, b in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True) if able else ():
                    for k in of[a:b].tolist():
                        if k in able:
                            seeds[k].append(j)
        out = []
        for k, places_of in sorted(seeds.items()):
            item, size = self.tokens[k], self.least[k]
            near = np.zeros(len(numbers) + 1, int)
            np.add.at(near, np.array(places_of), 1)
            np.add.at(near, np.array(places_of) + size, -1)
            near = np.cumsum(near)[:-1] > 0
            doc = np.where(near, numbers, 0)
            edge = np.flatnonzero(near)
            doc = doc[edge[0] : edge[-1] + 1]
            keep = (doc != 0) | np.r_[True, doc[:-1] != 0]  # of a gap one unmatched token is enough
            tiles = tile(doc[keep].tolist(), item, size)
            covered = sum(n for _, _, n in tiles) / len(item)
            if covered >= coverage:
                out.append((k, covered, len(tiles), max(n for _, _, n in tiles)))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest_tile of every contaminated pair."""
    lean(docs.sparkSession)
    rows = docs.select("doc_id", text_of().alias("text"))
    items = benchmark.select("item_id", text_of().alias("item_text"))
    kinds = dict(rows.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, n_tiles int, longest_tile int"
    size = items.agg(F.coalesce(F.sum(F.length("item_text") + 1), F.lit(0)).alias("n")).first()["n"]

    def made(doc_ids: pa.Array, found: list[tuple], ids: list) -> pa.RecordBatch:
        """found: (row, item number, coverage, tiles, longest tile)."""
        return pa.RecordBatch.from_arrays(
            [
                doc_ids.take(pa.array([f[0] for f in found], pa.int64())), pa.array([ids[f[1]] for f in found], item_type(kinds[1])),
                pa.array([f[2] for f in found], pa.float64()), *(pa.array([f[k] for f in found], pa.int32()) for k in (3, 4)),
            ],
            names=["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"],
        )

    if size <= broadcast:
        sent = rows.sparkSession.sparkContext.broadcast(sorted(((r[0], r[1]) for r in items.collect()), key=lambda r: (r[0] is None, r[0], r[1])))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trim()
            every = Items(sent.value, match)
            for b in batches:
                yield made(b.column(0), [(i, *m) for i, t in enumerate(b.column(1)) for m in every.matches(t.as_py(), coverage)], every.ids)

        return rows.mapInArrow(scan, schema)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in batches:
            found, ids = [], []
            for i, (text, item_id, item) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                ids.append(item_id)
                found += [(i, i, *m[1:]) for m in Items([(item_id, item)], match).matches(text, coverage)]
            yield made(b.column(0), found, ids)

    return _with_seeds(rows, items, match, coverage).mapInArrow(tiled, schema)


def seeds_of(text: str, sizes: list[int], match: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(size, distinct run hashes, places of each, words); an item has the one size that ``match`` gives it."""
    found = words(text)
    numbers = np.array([int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in found], np.uint64)
    for size in sizes if match is None else [min(match, len(found))]:
        if size and len(found) >= size:
            yield size, *grouped(windows(numbers, size)), len(found)


def _with_seeds(rows: DataFrame, items: DataFrame, match: int, coverage: float) -> DataFrame:
    """doc_id, text, item_id, item_text of the pairs whose shared seeds could cover enough of the item."""
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")

    def emit(sizes: list[int], limit: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trim()
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for size, hashes, places, n in seeds_of(text, sizes, limit):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(hashes), size, np.int32)), pa.array(hashes.astype(np.int64)), pa.array(np.full(len(hashes), key, np.int64)),
                             pa.array(places.astype(np.int64)), pa.array(np.full(len(hashes), n, np.int64))],
                            names=["size", "seed", "key", "places", "words"],
                        )
        return run

    kind = "size int, seed long, key long, places long, words long"
    of_items = materialize(items.select("item", "item_text").mapInArrow(emit([], match), kind), "seeds")
    sizes = sorted(r["size"] for r in of_items.select("size").distinct().collect())  # at most ``match`` numbers
    # a key that two rows share brings both texts to the tiling, so no pair is lost or made by it
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    of_docs = keyed.select("key", "text").mapInArrow(emit(sizes, None), kind).select("size", "seed", "key")
    met = of_docs.join(of_items.withColumnRenamed("key", "item"), ["size", "seed"]).groupBy("key", "item", "size", "words").agg(F.sum("places").alias("places"))
    pairs = met.where(F.col("places") * F.col("size") >= coverage * F.col("words")).select("key", "item")
    return pairs.join(items, "item").join(keyed, "key").select("doc_id", "text", "item_id", "item_text")


def item_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a contaminated pair, with all their columns; rows with a null id stay."""
    return without(docs, contaminated(docs, benchmark).where(F.col("doc_id").isNotNull()), "contaminated")
