"""Exact n-gram Jaccard self-join by vertical partitioning, and its connected components.

A document's set holds the 64-bit hashes of its distinct 5-word shingles; their order as numbers is the
global n-gram order. Sizes and overlaps are those of the hashes: exact unless two n-grams of the compared
documents share a 64-bit hash. That order is cut into fragments (ranges), and documents are compared fragment by
fragment:

* Candidates. Two sets with Jaccard similarity 0.8 or more differ in at most n/4 n-grams, n being the
  size of either. With more fragments than that, at least (occupied fragments - n/4) fragments hold the
  very same n-grams in both, so equal (fragment, content) signatures find every linked pair, and a
  document with fewer shared signatures than that has no link and leaves. The number of fragments goes
  by size class; a set that can have links into the next class has signatures there too. A set with too
  few occupied fragments for the bound also gives its prefix (the n - ceil(0.8 n) + 1 first n-grams of the
  order), the classic exact filter. A passage that thousands of documents share seldom fills whole
  fragments, and documents that share only the passage leave by the count, so it makes no pairs.
* Partial counts. The sets of candidates are cut into FRAGMENTS ranges; the overlap of a pair is counted
  in each fragment separately and summed per pair. The summed count decides the link, exactly.

Linked pairs are never expanded within a group of copies: equal sets are one node; a node is first
compared with a few hubs of its signatures' groups; then only nodes that are still in different
components but share a signature are compared, all of them. So no link between components is lost.

Hot keys: equal signatures are pre-aggregated in each batch before the shuffle (one entry a batch and
signature goes on), joins on a hot signature are split by AQE, and buckets of signatures are cut by the
counted number of n-grams, so that each is bounded.

Defined cases: a null text is empty; a set without n-grams is linked with nothing and its component is
its own id; with one to four words the whole sequence is the one n-gram. A row with a null id has its
n_shingles, no link and a null component. Of rows that repeat an id with different texts, the one with
the largest (n, digest) takes part in links; all report the id's component. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import stars
from .common import MAX_BROADCAST_IDS, ease, lean, materialize, text_of, trim, without

WORDS = 5
#: Ranges of the n-gram order for the partial counts; signatures that one bucket holds, about.
FRAGMENTS, BUCKET = 4, 600_000
#: Ratio of size classes; fragments of a class as a share of its largest size; hubs compared with
#: a node in one turn; turns; owners of a signature compared in one block.
RATIO, SHARE, HUBS, ROUNDS, OWNERS = 1.5, 0.34, 2, 2, 2048
PREFIX = 255
U = np.uint64
#: Bytes hashed at once; documents whose signatures are grouped at once.
SLICE, GROUP = 500_000, 1500
BREAK = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ U(salt)) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64 and of its inverse."""
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    out = []
    for r in (base, inverse):
        p, step = np.ones(1, U), r
        while len(p) < 1 << bits:
            p = np.concatenate([p, p * U(step)])
            step = step * step % (1 << 64)
        out.append(p)
    return out[0], out[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of lower-cased UTF-8 bytes; words end at bytes 9 to 13 and 32.

    Longer data goes piece by piece, cut at white space: a word's hash is the same wherever it stands.
    """
    if len(data) > 2 * SLICE:
        starts, hashes, low = [], [], 0
        while low < len(data):
            found = BREAK.search(data, low + SLICE)
            high = found.end() if found else len(data)
            start, words = _words_of(data[low:high])
            starts.append(start + low)
            hashes.append(words)
            low = high
        return np.concatenate(starts), np.concatenate(hashes)
    return _words_of(data)


def _words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.r_[False, solid, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(max(20, len(b).bit_length()))
    total = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * up[: len(b)], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start], 7) + mix((end - start).astype(U), 3)


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of each text."""
    todo, size = [], 0
    for t in texts:
        todo.append(t.encode("utf-8", "surrogatepass").lower())
        size += len(todo[-1])
        if size >= SLICE:
            yield from _sets(todo)
            todo, size = [], 0
    if todo:
        yield from _sets(todo)


def _sets(todo: list[bytes]) -> Iterator[np.ndarray]:
    start, words = word_hashes(b" ".join(todo))
    sizes = np.array([len(x) + 1 for x in todo])
    ends = np.searchsorted(start, np.cumsum(sizes))
    run = words[: len(words) - WORDS + 1].copy() if len(words) >= WORDS else np.zeros(0, U)
    for k in range(1, WORDS if len(run) else 0):
        run = (run ^ (run >> U(29))) * U(0xD6E8FEB86659FD93) + words[k : len(words) - WORDS + 1 + k]
    run = mix(run, 1)
    low = 0
    for high in ends.tolist():
        if high - low >= WORDS:
            yield np.unique(run[low : high - WORDS + 1])
        elif high > low:
            h = np.array([high - low], U)
            for w in words[low:high]:
                h = mix(h, 5) + w
            yield mix(h, 2)
        else:
            yield np.zeros(0, U)
        low = high


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set, as two signed numbers."""
    return tuple(int(mix(s, salt).sum(dtype=U).astype(np.int64)) for salt in (101, 202))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Lower ends of the size classes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out, np.int64)


def signatures(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, class, need) of a set: one entry for each occupied fragment of its classes."""
    n, lows = len(s), classes()
    sigs, kinds, needs, covered = [], [], [], True
    home = int(np.searchsorted(lows, n, "right")) - 1
    for c in [home, home + 1] if 5 * n >= 4 * int(lows[home + 1]) else [home]:
        fragments = max(1, int(np.ceil(SHARE * int(lows[c + 1]))))
        at = ((s >> U(32)) * U(fragments)) >> U(32)  # ranges of the global order
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        content = np.add.reduceat(mix(s, 11), first)
        sigs.append(mix(content ^ mix(at[first], 13), 17 + c))
        need = len(first) - n // 4
        covered &= need >= 1
        kinds.append(np.full(len(first), c, np.uint8))
        needs.append(np.full(len(first), max(1, need), np.int32))
    if not covered:
        prefix = s[: n - (-(-4 * n // 5)) + 1]
        sigs.append(mix(prefix, 19))
        kinds.append(np.full(len(prefix), PREFIX, np.uint8))
        needs.append(np.ones(len(prefix), np.int32))
    return np.concatenate(sigs), np.concatenate(kinds), np.concatenate(needs)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n, d1, d2 of every row."""
    rows = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in batches:
            found = [(len(s), *digest(s)) for s in shingle_sets(b.column(1).to_pylist())]
            table = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(table[:, k]) for k in range(3))], names=["doc_id", "n", "d1", "d2"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, d1 long, d2 long")


def shared_signatures(rows: DataFrame, buckets: int) -> DataFrame:
    """sig, node, kind, need for all signatures that two or more nodes have; rows: node, d1, text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trim()
        part, number = TaskContext.get().partitionId(), 0
        for b in (whole.slice(k, GROUP) for whole in batches for k in range(0, whole.num_rows, GROUP)):
            nodes, wanted, entries = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for node, want, s in zip(nodes, wanted, shingle_sets(b.column(2).to_pylist()), strict=True):
                if len(s) and digest(s)[0] == want:
                    sig, kind, need = signatures(s)
                    entries.append((sig, np.full(len(sig), node), kind, need))
            if not entries:
                continue
            sig, node, kind, need = (np.concatenate(x) for x in zip(*entries, strict=True))
            order = np.lexsort((node, sig))
            sig, node, kind, need = sig[order], node[order], kind[order], need[order]
            fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
            sig, node, kind, need = sig[fresh], node[fresh], kind[fresh], need[fresh]
            begins = np.r_[True, sig[1:] != sig[:-1]]
            size = np.diff(np.r_[np.flatnonzero(begins), len(sig)])
            local = np.repeat(size > 1, size)
            # members of a group within this batch are known to share: they pass through, one entry goes on
            number += 1
            passed = -1 - (part * 1_000_003 + number)
            bucket = np.where(begins, ((sig >> U(32)) * U(buckets)) >> U(32), U(0)).astype(np.int64)
            go = np.flatnonzero(begins)
            go = go[np.argsort(bucket[go], kind="stable")]
            cuts = np.r_[0, np.flatnonzero(np.diff(bucket[go])) + 1, len(go)]
            groups = [(int(bucket[go[i]]), go[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            if local.any():
                groups.append((passed, np.flatnonzero(local)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in groups], pa.int64()),
                    pa.array([sig[i].tobytes() for _, i in groups], pa.binary()),
                    pa.array([node[i].astype("<i8").tobytes() for _, i in groups], pa.binary()),
                    pa.array([kind[i].tobytes() for _, i in groups], pa.binary()),
                    pa.array([need[i].astype("<i4").tobytes() for _, i in groups], pa.binary()),
                    pa.array([local[i].tobytes() for _, i in groups], pa.binary()),
                ],
                names=["bucket", "sig", "node", "kind", "need", "known"],
            )

    def gather(key, table):
        columns = [b"".join(x.as_py() for x in table[c]) for c in ("sig", "node", "kind", "need", "known")]
        sig, node, kind, need, known = (np.frombuffer(c, t) for c, t in zip(columns, ("<u8", "<i8", "u1", "<i4", "?"), strict=True))
        if key[0].as_py() >= 0:
            order = np.argsort(sig, kind="stable")
            s = sig[order]
            begins = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
            size = np.diff(np.r_[begins, len(s)])
            keep = order[np.repeat(size > 1, size)]
            keep = keep[~known[keep]]  # the others passed through
            sig, node, kind, need = sig[keep], node[keep], kind[keep], need[keep]
        return pa.table({
            "sig": pa.array(sig.astype("<i8") if len(sig) else np.zeros(0, np.int64)), "node": pa.array(node.astype(np.int64)),
            "kind": pa.array(kind.astype(np.int32)), "need": pa.array(need.astype(np.int32)),
        })

    blobs = rows.mapInArrow(emit, "bucket long, sig binary, node binary, kind binary, need binary, known binary")
    # as many tasks as buckets, so that a task holds about one at any size of the input
    return blobs.repartition(buckets + 7, "bucket").groupBy("bucket").applyInArrow(gather, "sig long, node long, kind int, need int")


def segments(rows: DataFrame) -> DataFrame:
    """node, frag, seg: the n-grams of each set by range of the global order, and at -1 - class its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in batches:
            out = []
            for node, want, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2).to_pylist()), strict=True):
                if len(s) and digest(s)[0] == want:
                    cuts = np.searchsorted(s, [U((k << 64) // FRAGMENTS) for k in range(1, FRAGMENTS)])
                    out += [(node, k, part.tobytes()) for k, part in enumerate(np.split(s, cuts)) if len(part)]
                    out += [(node, -1 - k, sketch(s, k).tobytes()) for k in {int(x) for x in signatures(s)[1]}]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())],
                names=["node", "frag", "seg"],
            )

    return rows.mapInArrow(run, "node long, frag int, seg binary")


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
        part = [_common(np.frombuffer(x, U), np.frombuffer(y, U)) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part, pa.int64())], names=["a", "b", "part"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    z = np.concatenate([x, y])
    z.sort(kind="stable")  # two sorted runs
    return int((z[1:] == z[:-1]).sum())


def linked(pairs: DataFrame, segs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= 80 * union: partial counts by fragment, summed per pair."""
    na, nb = sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), sizes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    sized = pairs.join(na, "a").join(nb, "b").where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
    cut = sized.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("frag"))
    left, right = segs.select(F.col("node").alias("a"), "frag", F.col("seg").alias("x")), segs.select(F.col("node").alias("b"), "frag", F.col("seg").alias("y"))
    met = cut.join(right, ["b", "frag"]).join(left, ["a", "frag"]).select("a", "b", "x", "y")
    total = met.mapInArrow(overlaps, "a long, b long, part long").groupBy("a", "b").agg(F.sum("part").alias("both"))
    found = total.join(na, "a").join(nb, "b")
    return found.where(100 * F.col("both") >= 80 * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable); the smallest node of a component has no row."""
    return stars(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("node"), F.col("v").alias("comp"))


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, comp after further links (a, b): only the components that these links join are searched."""
    if comp is None:
        return components(links)
    ends = (comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    for x, end in zip("ab", ends, strict=True):
        links = links.join(end, x, "left").withColumn(x, F.coalesce(f"c{x}", x)).select("a", "b")
    roots = components(links)
    moved = comp.join(roots.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left")
    return materialize(moved.select("node", F.coalesce("root", "comp").alias("comp")).unionByName(roots), "components")


def prefixes(found: DataFrame) -> DataFrame:
    """sig, node: the signatures by which a node must meet any node that it is linked with.

    A link shares ``need`` signatures of a class or more, all of them with a second owner. A node with
    fewer such signatures leaves. Of the others' signatures, rarest first, the prefix filter keeps all but
    the need - 1 most frequent ones, so common passages drop out.
    """
    per = Window.partitionBy("node", "kind")
    enough = found.withColumn("have", F.count(F.lit(1)).over(per)).where("have >= need").select("sig", "node", "kind", "need")
    enough = materialize(enough, "enough")
    owners = enough.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    again = enough.join(owners, "sig").withColumn("have", F.count(F.lit(1)).over(per)).where("have >= need")
    place = F.row_number().over(per.orderBy("df", "sig"))
    return again.withColumn("place", place).where("place <= have - need + 1").select("sig", "node", "kind")


def across(kept: DataFrame, comp: DataFrame) -> DataFrame:
    """sig, node, comp of the signatures whose owners are in more than one component."""
    placed = kept.join(comp, "node", "left").select("sig", "node", "kind", F.coalesce("comp", "node").alias("comp"))
    open_ = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("sig")
    return placed.join(open_, "sig", "left_semi")


def sketch_bits(kind: int) -> int:
    """Bits of the sketches of a class: four times its largest size."""
    return 1024 if kind == PREFIX else -(-4 * int(classes()[kind + 1]) // 64) * 64


def sketch(s: np.ndarray, kind: int) -> np.ndarray:
    """Parity bits of a set: two sets differ in at least as many n-grams as their sketches differ in bits."""
    bits = sketch_bits(kind)
    odd = np.bincount((mix(s, 23) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def cross_pairs(rest: DataFrame, segs: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, b: nodes of different components that share a signature of ``rest``, unless their sketches prove
    that they differ too much for a link.

    The owners of one signature are compared within one task, in blocks of about OWNERS by hash, each
    block with each; only pairs that the sketches let through become rows.
    """
    bits = segs.where("frag < 0").select("node", (-1 - F.col("frag")).alias("kind"), F.col("seg").alias("bits"))
    blocks = rest.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / OWNERS).cast("int").alias("blocks"))
    rows = rest.join(blocks, "sig").join(bits, ["node", "kind"]).join(sizes, "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "comp", "n", "bits")
    dealt = rows.repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high", "node")
    return dealt.mapInArrow(_let_through, "a long, b long").distinct()


def _let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left = None
    for b in batches:
        t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
        key = np.stack([t[c].to_numpy().astype(np.int64) for c in ("sig", "low", "high")])
        starts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1]
        if len(starts) > 1:
            yield _pairs_of(t.slice(0, int(starts[-1])), starts[:-1])
        left = t.slice(int(starts[-1]))  # the last group may go on
    if left is not None:
        yield _pairs_of(left, np.array([0]))


def _pairs_of(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    low, high, own, node, comp, n = (t[c].to_numpy() for c in ("low", "high", "own", "node", "comp", "n"))
    bits, out = t["bits"].to_pylist(), []
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
        matrix = np.frombuffer(b"".join(bits[i:j]), U).reshape(j - i, -1)
        g = slice(i, j)
        for k in range(j - i - 1):
            rest = slice(i + k + 1, j)
            ok = (comp[rest] != comp[i + k]) & (5 * np.minimum(n[rest], n[i + k]) >= 4 * np.maximum(n[rest], n[i + k]))
            if low[i] != high[i]:
                ok &= own[rest] != own[i + k]
            at = np.flatnonzero(ok) + k + 1
            differ = np.bitwise_count(matrix[at] ^ matrix[k]).sum(axis=1, dtype=np.int64)
            at = at[9 * differ <= n[g][at] + n[i + k]]
            out.append(np.stack([np.minimum(node[g][at], node[i + k]), np.maximum(node[g][at], node[i + k])], axis=1))
            if len(out) >= 4096:
                out = [np.unique(np.concatenate(out), axis=0)]
    pairs = np.unique(np.concatenate(out), axis=0).astype(np.int64) if out else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def hub_pairs(kept: DataFrame, comp: DataFrame, sizes: DataFrame, turn: int) -> DataFrame:
    """a, b: each node with the few hubs of other components that it meets most often.

    A signature's hub is one of its owners, another one each turn: first the smallest, then any by hash.
    """
    rest = materialize(across(kept, comp).join(sizes, "node"), "open")
    order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    hubs = rest.groupBy("sig").agg(F.min_by(F.struct("node", "comp", "n"), order).alias("h"))
    hubs = hubs.select("sig", F.col("h.node").alias("hub"), F.col("h.comp").alias("hc"), F.col("h.n").alias("hn"))
    met = rest.join(hubs, "sig").where("comp <> hc AND 5 * least(n, hn) >= 4 * greatest(n, hn)").groupBy("node", "hub").count()
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("count"), "hub"))
    pairs = met.withColumn("r", best).where(F.col("r") <= HUBS)
    return materialize(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "near")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    lean(docs.sparkSession)
    ease(docs.sparkSession)
    rows = materialize(measured(docs), "sizes")
    standing = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.max(F.struct("n", "d1", "d2")).alias("s"), F.count(F.lit(1)).alias("rows"))
    standing = standing.select("doc_id", "s.*", "rows")
    nodes = standing.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), F.max("rows").alias("rows"))
    nodes = materialize(nodes.select(F.col("node").cast("long").alias("node"), "n", "d1", "d2", "rows"), "nodes")
    count = nodes.agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.max("rows").alias("rows")).first()
    repeated = (count["rows"] or 0) > 1
    source = docs.select(F.col("doc_id").cast("long").alias("node"), text_of().alias("text"))

    def texts(wanted: DataFrame, n: int) -> DataFrame:
        wanted = wanted.select("node", "d1")
        return source.join(F.broadcast(wanted) if n <= MAX_BROADCAST_IDS else wanted, "node").select("node", "d1", "text")

    def once(found: DataFrame, *key: str) -> DataFrame:
        """Each row of a repeated id gives its set again: of those one counts."""
        return found.dropDuplicates([*key]) if repeated else found

    buckets = max(1, -(-int((count["n"] or 0) * 0.6) // BUCKET))
    found = materialize(once(shared_signatures(texts(nodes, count["c"]), buckets), "sig", "node"), "shared")
    kept = materialize(prefixes(found), "kept")
    ease(docs.sparkSession)
    alive = materialize(kept.select("node").distinct().join(nodes, "node"), "alive")
    segs = materialize(once(segments(texts(alive, alive.count())), "node", "frag"), "segments")
    sizes = alive.select("node", "n")
    links, alone = None, sizes.select("node", F.col("node").alias("comp"))
    for turn in range(ROUNDS):
        near = hub_pairs(kept, alone if links is None else links, sizes, turn)
        if near.isEmpty():
            break
        links = merged(links, materialize(linked(near, segs, alive), "links"))
        ease(docs.sparkSession)
    # whatever shares a signature across components is compared, all of it
    last = materialize(cross_pairs(across(kept, alone if links is None else links), segs, sizes), "near")
    comp = merged(links, materialize(linked(last, segs, alive), "links"))
    ease(docs.sparkSession)
    whole = rows.join(standing.select("doc_id", F.struct("n", "d1", "d2").alias("s")), "doc_id", "left")
    named = whole.select("doc_id", F.col("n").alias("own"), "s").join(nodes.select(F.struct("n", "d1", "d2").alias("s"), "node"), "s", "left").join(comp, "node", "left")
    return named.select("doc_id", F.col("own").alias("n_shingles"), F.coalesce("comp", "node", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group stays, the one with the smallest id; all columns stay."""
    return without(docs, join(docs).where("doc_id <> component_id"), "near")


#: All pairs by their common n-grams, and components by reach: for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM g p JOIN g q ON p.gram = q.gram AND p.doc_id < q.doc_id GROUP BY ALL)
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS other FROM ways UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
