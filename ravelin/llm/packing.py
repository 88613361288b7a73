"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands.

Tokenising gives one narrow row per piece: a document longer than a sequence is cut into full pieces,
of which only the first may be shorter. Full pieces are sequences of their own. All others are dealt at
random into blocks of about BLOCK pieces, each packed by itself: best-fit decreasing first, and where
that misses the lower bound, islands of packings evolve. Crossover injects whole well-filled bins of
one parent into the other, drops the other's bins that hold a piece twice, exchanges displaced pieces for
smaller ones where that fills a bin, and best-fits the rest; mutation empties some badly filled bins. Between
epochs each island's elite moves to the next island of its block; a block goes on as long as an epoch saves a
bin for it. The badly filled bins of all blocks then meet in new blocks and are packed again.
A block is bounded whatever the keys look like (pieces are dealt by row, not by id), so work per task
is constant and the number of tasks follows the input.

Defined cases: a null text is empty; every document, also an empty one, ends with id 0, so each row has
a piece; repeated ids are separate documents; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, text_of, trim

CAPACITY, BLOCK = 2048, 4096
#: Islands a block, most epochs, generations an epoch, packings an island, elites that move.
ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITES = 3, 6, 100, 8, 2
#: Bins and loose pieces that one exchange looks at; generations without a saved bin that end an epoch.
TRIED, PATIENCE = 40, 25
#: Bins filled less than this meet again across blocks.
WELL_FILLED = 0.97
#: Chunks that a worker remembers with their ids; the memory is emptied when it is full.
MEMO = 350_000


class Ids:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The byte-level pattern always starts a new pre-token at a space before a visible character, so a
    text is the concatenation of its space-separated chunks and chunks can be remembered. Texts with
    other spacing or with a special string go to the tokenizers library as a whole. Chunks are encoded
    by the rank file of the same vocabulary, which gives the library's ids several times faster.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str) -> None:
        import json
        import re

        import tiktoken

        self.path, self.loaded = path, None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        with open(path, "rb") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.odd = re.compile(r" (?=\s)| $")
        self.memo: dict[str, bytes] = {}

    @property
    def library(self):
        if self.loaded is None:  # most tasks never need it
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        if self.odd.search(text) or any(x in text for x in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            tail = b"".join(map(memo.__getitem__, rest))
        except KeyError:
            for w in rest:
                if w not in memo:
                    memo[w] = self.chunk(" " + w)
            tail = b"".join(map(memo.__getitem__, rest))
        return self.chunk(first) + tail

    def chunk(self, text: str) -> bytes:
        if text[1:].isalpha() and text[0] == " " and max(text) < "\u0250":  # Latin letters: one pre-token
            return array("I", self.quick._encode_single_piece(text.encode())).tobytes()
        return np.array(self.quick.encode_ordinary(text), "<u4").tobytes()


@lru_cache(maxsize=2)
def _ids(path: str, ranks_path: str, pattern: str) -> Ids:
    return Ids(path, ranks_path, pattern)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ``uid``, which deals the rows out."""
    lean(docs.sparkSession)
    rows = docs.select("doc_id", text_of().alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        own = _ids(path, ranks_path, pattern)
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(1)):
                ids = memoryview(own.of(text.as_py()) + b"\0\0\0\0")
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(i)
                    out.append((k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            table = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(table[:, 0], pa.int32()), *(pa.array(table[:, k], pa.int64()) for k in (1, 2, 3))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    found = rows.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")
    return found.withColumn("uid", F.monotonically_increasing_id())


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: volume, or pieces over half, with what cannot join them."""
    best = -(-int(lengths.sum()) // capacity)
    for low in np.unique(lengths[lengths <= capacity // 2])[:64]:
        big = int((lengths > capacity - low).sum())
        half = lengths[(lengths > capacity // 2) & (lengths <= capacity - low)]
        small = lengths[(lengths >= low) & (lengths <= capacity // 2)]
        room = len(half) * capacity - int(half.sum())
        best = max(best, big + len(half) + max(0, -(-(int(small.sum()) - room) // capacity)))
    return max(best, int((lengths > capacity // 2).sum()))


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, fill: list[int], capacity: int = CAPACITY) -> None:
    """Put the pieces ``order`` into the fullest bins that take them; bins and fill are changed.

    Bit r of ``open_`` tells that a bin with r tokens of room exists: the tightest fit is the lowest
    set bit from the piece's length on.
    """
    by_room: dict[int, list[int]] = {}
    open_ = 0
    for b, f in enumerate(fill):
        if f < capacity:
            by_room.setdefault(capacity - f, []).append(b)
            open_ |= 1 << (capacity - f)
    for i in order.tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            same = by_room[room]
            b = same.pop()
            if not same:
                open_ &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i] = b
        fill[b] += n
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            open_ |= 1 << (room - n)


def first_packing(lengths: np.ndarray, noise: np.ndarray | None = None) -> np.ndarray:
    """Best-fit decreasing; noise disturbs the order."""
    bins = np.full(len(lengths), -1)
    best_fit(lengths, np.argsort(-(lengths if noise is None else lengths * noise), kind="stable"), bins, [])
    return bins


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int = CAPACITY) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = np.bincount(bins, lengths) / capacity
    fill = fill[fill > 0]
    return -len(fill), float((fill * fill).sum())


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def repack(lengths: np.ndarray, bins: np.ndarray, loose: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The packing with the pieces ``loose`` taken out, exchanged for smaller ones where that fills a bin, and the rest best-fitted."""
    out = bins.copy()
    out[loose] = -1
    kept = out >= 0
    out[kept] = compact(out[kept])
    exchange(lengths, out, rng)
    kept = out >= 0
    fill = np.bincount(out[kept], lengths[kept]).astype(int).tolist() if kept.any() else []
    at = np.flatnonzero(~kept)
    best_fit(lengths, at[np.argsort(-lengths[at], kind="stable")], out, fill)
    return out


def exchange(lengths: np.ndarray, bins: np.ndarray, rng: np.random.Generator, capacity: int = CAPACITY) -> None:
    """One or two loose pieces (bin -1) for one or two smaller ones of a bin, the best fit first; bins is changed.

    Every exchange makes a bin fuller and what is left over smaller, which is easier to place. At most
    TRIED open bins and TRIED loose pieces are looked at in one call.
    """
    loose = np.flatnonzero(bins < 0)
    if not len(loose) or len(loose) == len(bins):
        return
    kept = np.flatnonzero(bins >= 0)
    fill = np.bincount(bins[kept], lengths[kept]).astype(int)
    open_ = np.flatnonzero(fill < capacity)
    if not len(open_):
        return
    looked = np.zeros(len(fill), bool)
    looked[rng.permutation(open_)[:TRIED]] = True
    held: dict[int, list[int]] = {}
    for i in kept[looked[bins[kept]]].tolist():
        held.setdefault(int(bins[i]), []).append(i)
    size = lengths.tolist()
    loose = rng.permutation(loose)[:TRIED].tolist()
    offers = sorted([(size[i], (i,)) for i in loose] + [(size[i] + size[j], (i, j)) for k, i in enumerate(loose) for j in loose[:k] if size[i] + size[j] <= capacity], key=lambda x: x[0])
    sums = np.array([n for n, _ in offers])
    places = [(int(sum(size[i] for i in one)), one, b) for b, items in held.items() for one in [*((i,) for i in items), *itertools.combinations(items[:8], 2)]]
    at = np.searchsorted(sums, np.array([n + capacity - fill[b] for n, _, b in places]), "right") - 1
    gain = np.where(at >= 0, sums[at] - np.array([n for n, _, _ in places]), 0)
    gone, changed = set(), set()
    for k in np.argsort(-gain, kind="stable").tolist():
        if gain[k] <= 0:
            break
        _, one, b = places[k]
        new = offers[at[k]][1]
        if b not in changed and not gone.intersection(new):
            bins[list(new)], bins[list(one)] = b, -1
            gone.update(new)
            changed.add(b)


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of b come into a; a's bins with a piece of them go; what they held is best-fitted."""
    fill = np.bincount(b, lengths)
    share = rng.uniform(0.1, 0.5)
    good = np.argsort(-fill * rng.uniform(0.9, 1.0, len(fill)), kind="stable")[: max(1, int(share * len(fill)))]
    injected = np.isin(b, good)
    broken = np.isin(a, a[injected]) & ~injected
    child = np.where(injected, b + a.max() + 1, a)
    return repack(lengths, child, broken, rng)


def mutate(lengths: np.ndarray, bins: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A few bins, badly filled ones above all, are emptied and their pieces placed again."""
    fill = np.bincount(bins, lengths)
    worst = np.argsort(fill * rng.uniform(0.7, 1.0, len(fill)))[: rng.integers(2, 3 + max(4, len(fill) // 50))]
    return repack(lengths, bins, np.isin(bins, worst), rng)


def evolve(lengths: np.ndarray, start: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """One island, one epoch; its elite, best first."""
    rng = np.random.default_rng(seed)
    bound = lower_bound(lengths)
    group = [(fitness(lengths, p), p) for p in start]
    while len(group) < POPULATION:
        p = first_packing(lengths, rng.uniform(0.85, 1.0, len(lengths)))
        group.append((fitness(lengths, p), p))
    group.sort(key=lambda x: x[0], reverse=True)
    best, since = group[0][0][0], 0
    for _ in range(GENERATIONS):
        since = 0 if group[0][0][0] > best else since + 1
        best = group[0][0][0]
        if -best <= bound or since > PATIENCE:
            break
        i, j = sorted(rng.choice(len(group), 2, replace=False))
        for child in (crossover(lengths, group[i][1], group[j][1], rng), mutate(lengths, group[rng.choice(3)][1], rng)):
            score = fitness(lengths, child)
            if score > group[-1][0] and all(score != x for x, _ in group):  # a copy adds nothing
                group[-1] = (score, child)
                group.sort(key=lambda x: x[0], reverse=True)
    return [compact(p) for _, p in group[:ELITES]]


def _ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<i4").astype(np.int64)


def _bytes(x: np.ndarray) -> bytes:
    return x.astype("<i4").tobytes()


def pack_blocks(items: DataFrame, blocks: int) -> DataFrame:
    """uid, block, bin, length for items (uid, length) dealt into that many blocks."""
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))

    def seed_block(key, table):
        uid, lengths = table["uid"].to_numpy(), table["length"].to_numpy()
        order = np.argsort(uid, kind="stable")
        uid, lengths = uid[order], lengths[order]
        bins = compact(first_packing(lengths))
        return pa.table({
            "block": pa.array([key[0].as_py()], pa.int64()), "uids": pa.array([uid.astype("<i8").tobytes()], pa.binary()),
            "lengths": pa.array([_bytes(lengths)], pa.binary()), "bins": pa.array([_bytes(bins)], pa.binary()),
            "used": pa.array([int(bins.max()) + 1], pa.int32()), "open": pa.array([int(bins.max()) + 1 > lower_bound(lengths)], pa.bool_()),
        })

    shape = "block long, uids binary, lengths binary, bins binary, used int, open boolean"
    first = materialize(dealt.groupBy("block").applyInArrow(seed_block, shape), "blocks")

    def epoch(number: int):
        def run(key, table):
            block, island = key[0].as_py(), key[1].as_py()
            lengths = _ints(table["lengths"][0].as_py())
            start = sorted({x.as_py() for x in table["bins"]})
            best = [_bytes(p) for p in evolve(lengths, [_ints(x) for x in start], (block * 31 + island) * 31 + number)]
            to = [island] * len(best) + [(island + 1) % ISLANDS]  # the elite stays, its best also moves on
            used = [len(set(_ints(x).tolist())) for x in (*best, best[0])]
            return pa.table({
                "block": pa.array([block] * len(to), pa.int64()), "island": pa.array(to, pa.int32()),
                "lengths": pa.array([table["lengths"][0].as_py()] * len(to), pa.binary()), "bins": pa.array([*best, best[0]], pa.binary()),
                "used": pa.array(used, pa.int32()), "bound": pa.array([lower_bound(lengths)] * len(to), pa.int32()),
            })
        return run

    islands = first.where("open").select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", "bins")
    reached, ends = first.where("open").select("block", F.col("used").alias("before")), []
    for number in range(EPOCHS):
        grown = "block long, island int, lengths binary, bins binary, used int, bound int"
        now = materialize(islands.groupBy("block", "island").applyInArrow(epoch(number), grown), "islands")
        ends.append(now.select("block", "lengths", "bins"))
        # blocks that an epoch gains nothing for, or that meet the bound, are done
        state = now.groupBy("block").agg(F.min("used").alias("now"), F.max("bound").alias("bound")).join(reached, "block").where("now < before AND now > bound")
        state = materialize(state.select("block", F.col("now").alias("before")), "gained")
        if state.isEmpty():
            break
        islands, reached = now.join(state, "block", "left_semi"), state

    def best_of(key, table):
        lengths = _ints(table["lengths"][0].as_py())
        best = max((fitness(lengths, _ints(x)), x) for x in {y.as_py() for y in table["bins"]})[1]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "better": pa.array([best], pa.binary())})

    best = reduce(DataFrame.unionByName, ends).groupBy("block").applyInArrow(best_of, "block long, better binary")
    ended = first.join(best, "block", "left").select("block", "uids", "lengths", F.coalesce("better", "bins").alias("bins"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, uids, lengths, bins in zip(*(c.to_pylist() for c in b.columns), strict=True):
                uid = np.frombuffer(uids, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), pa.array(np.full(len(uid), block)), pa.array(_ints(bins)), pa.array(_ints(lengths))],
                    names=["uid", "block", "bin", "length"],
                )

    return ended.mapInArrow(spread, "uid long, block long, bin long, length long")


def pack(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """The materialised rows of :func:`pieces` with sequence_id and offset."""
    items = rows.where(F.col("length") < capacity).select("uid", "length")
    n = items.count()
    first = materialize(pack_blocks(items, max(1, round(n / block))), "packed")
    fills = first.groupBy("block", "bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < WELL_FILLED * capacity)
    weak = materialize(first.join(fills.select("block", "bin"), ["block", "bin"], "left_semi").select("uid", "length"), "weak")
    m = weak.count()
    second = pack_blocks(weak, max(1, round(m / block))).withColumn("round", F.lit(1)) if m else None
    done = first.join(weak.select("uid"), "uid", "left_anti").withColumn("round", F.lit(0))
    done = done if second is None else done.unionByName(second)
    within = F.sum("length").over(_in_bin())
    placed = done.select(
        "uid", (F.col("block") * (2 * block * 16) + F.col("bin") * 2 + F.col("round")).alias("sequence_id"),
        (within - F.col("length")).alias("offset"),
    )
    full = rows.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rows.join(placed.unionByName(full), "uid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def _in_bin():
    from pyspark.sql import Window

    return Window.partitionBy("round", "block", "bin").orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def pack_documents(docs: DataFrame, path: str, ranks_path: str, pattern: str) -> DataFrame:
    return pack(materialize(pieces(docs, path, ranks_path, pattern), "pieces"))
