"""The corpus operators against SQL, brute force, exact round trips and held-out accuracy, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import agrees
from pyspark.sql import functions as F

from ravelin.llm import chat, common, decontam, exact_dedup, ngram_join, packing, quality, queries, secrets, token_count, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, node long, _hash string"
LONG = "long word " * 30_000
ODD = [
    (1, None), (2, ""), (3, " \t"), (4, "one"), (5, "one"), (5, "one"), (6, "same words in a row twice"), (7, "same  words\nin a row twice"),
    (8, LONG), (9, LONG), (None, "one"), (10, "ＵＮＩcode Ünï \x0b x"), (11, "SAME words in a row twice"), (12, "\x1cfs"), (13, "a\x85b"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(name, spark, sf_dir):
    agrees(queries.QUERIES[name], queries.ORACLES[name], spark, sf_dir)


def test_exact_dedup(spark, odd, none):
    norm = lambda t: re.sub("[\x20\t-\r]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in ODD:
        groups[norm(t)].append(i)
    want = []
    for i, t in ODD:
        g = groups[norm(t)]
        keep = min(x for x in g if x is not None)
        want.append((str(i), keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    for content_hash in (F.md5, lambda c: F.substring(F.md5(c), 1, 1)):  # the second one collides
        got = [(str(r[0]), *r[1:]) for r in exact_dedup.decide(odd, content_hash).collect()]
        assert sorted(got) == sorted(want)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, *_, k, _ in [(w[0], w[1], w[2], w[3], w[4]) for w in want] if k or i == "None")
    assert exact_dedup.decide(none).count() == exact_dedup.drop_copies(none).count() == 0


def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", r"\\<turn>", "<turn></turn></turn>\\", "", None, "a\n</turn>\n<turn>user\nb", "é😀\\", LONG]
    roles = ["user", "assistant", "x-y\nz", None, "system", "assistant", "assistant", "tool"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(roles, texts, strict=True))] + [(2, 0, "user", "only"), (None, None, "assistant", "n"), (None, None, "assistant", "n")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.expand(data)).collect()}
    for c in (1, 2, None):
        turns = [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.expand(data).where("conv_id = 1").orderBy("position").collect()
    assert [e["trainable"] for e in examples] == [True, True, True, False]
    assert chat.digest(chat.expand(data.limit(0))).count() == 0


def test_long_runs_of_backslashes(spark):
    import time

    texts = ["\\" * 200_000, "\\" * 100_001 + "<turn>", "a" + "\\" * 7 + "</turn>" + "\\" * 3 + "<turn>\\", "<turn></turn>\\<turn>"]
    data = spark.createDataFrame([(1, k, "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    began = time.time()
    got = chat.digest(chat.expand(data)).first()
    assert time.time() - began < 20
    assert got["loss_sha256"] == hashlib.sha256("".join(texts).encode()).hexdigest()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(r.choices(vocabulary, k=30))
    rows, n = [], 0
    for _ in range(40):
        base = r.choices(vocabulary, k=r.choice([3, 5, 6, 9, 14, 25, 60, 150]))
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((n, " ".join(w) + (f" {passage}" if r.random() < 0.3 else "")))
            n += 1
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_ngram_join_odd(spark, odd, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (7, 2, 6), (11, 2, 6), (9, 2, 8), (None, 1, None)} <= got
    assert ngram_join.join(none).count() == 0
    kept = ngram_join.drop_near_copies(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 8, None, 10, 12, 13}


def test_ngram_join_counts_a_repeated_row_once(spark):
    r = random.Random(9)
    rows = []
    for n in range(0, 60, 2):
        base = [f"w{n}_{k}" for k in range(100)]
        near = base[: 96 if n % 10 == 0 else 82 + n % 4]  # similarity 0.92 is a link, 0.68 to 0.71 is none
        changed = [*near, *(f"x{n}_{k}" for k in range(100 - len(near)))] if n % 3 else near[:70]
        rows += [(n, " ".join(base))] * r.choice([2, 3]) + [(n + 1, " ".join(changed))] * r.choice([1, 2])
    rows += [(0, rows[0][1].upper())]  # another text, the same set
    r.shuffle(rows)
    got = {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.join(docs_of(spark, rows)).collect()}
    assert got == {(i, *x) for i, x in brute_components(rows).items()}
    assert {x["doc_id"] for x in ngram_join.drop_near_copies(docs_of(spark, rows)).collect()} == {c for _, _, c in got}


def test_words_of_long_texts_are_hashed_piece_by_piece():
    r = random.Random(3)
    for data in (b" ".join(b"w%d" % r.randrange(10**6) for _ in range(300_000)), b"x" * 2_000_000, b"y" * 1_200_000 + b" z " + b"q" * 900_000, b" " * 1_500_000):
        start, words = ngram_join.word_hashes(data)
        whole_start, whole = ngram_join._words_of(data)
        assert (start == whole_start).all() and (words == whole).all()


def test_sketches_never_overstate():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 200)).astype(np.uint64))
        b = np.unique(np.r_[a[r.random(len(a)) < 0.9], r.integers(0, 1 << 63, 5).astype(np.uint64)])
        kind = int(ngram_join.signatures(a)[1][0])
        bits = np.bitwise_count(ngram_join.sketch(a, kind) ^ ngram_join.sketch(b, kind)).sum()
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_groups_may_span_batches():
    import pyarrow as pa

    r = np.random.default_rng(2)
    n = 60
    t = pa.table({
        "sig": np.sort(r.integers(0, 4, n)), "low": np.zeros(n, np.int32), "high": np.zeros(n, np.int32), "own": np.zeros(n, np.int32),
        "node": np.arange(n), "comp": np.arange(n) // 3, "n": np.full(n, 90), "bits": [r.integers(0, 2, 2).astype(np.uint64).tobytes() for _ in range(n)],
    })
    runs = [
        {tuple(p) for b in ngram_join._let_through(iter(t.to_batches(max_chunksize=size))) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        for size in (1, 7, n)
    ]
    assert runs[0] == runs[1] == runs[2] != set()
    assert list(ngram_join._let_through(iter([]))) == []


def test_tiles():
    doc, item = [1, 2, 3, 4, 5, 0, 6, 7, 8, 9, 10, 11, 0], [6, 7, 8, 9, 10, 11, 1, 2, 3, 4, 5]
    assert sorted(decontam.tile(doc, item, 5)) == [(0, 6, 5), (6, 0, 6)]
    assert decontam.tile([1, 2, 3, 4], [1, 2, 3, 4, 5], 5) == []
    assert decontam.tile([1, 1, 1, 1, 1, 1], [1, 1, 1, 1], 2) == [(0, 0, 4)]


def test_decontamination(spark, odd, none):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(r.choices(vocabulary, k=40))) for k in range(20)] + [(50, "tiny item"), (51, None), (52, "")]
    halves = items[3][1].split()
    rows = [
        (1, "x " * 50 + items[2][1].upper() + " y" * 9), (2, " ".join(halves[20:] + ["z"] * 7 + halves[:20])),
        (3, " ".join(r.choices(vocabulary, k=400))), (4, "a tiny item here"), (5, " ".join(items[4][1].split()[:12])), (6, None),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontam.contaminated(docs_of(spark, rows), bench).collect()}
    assert got.keys() == {(1, 2), (2, 3), (4, 50)}
    assert got[2, 3]["n_tiles"] == 2 and got[2, 3]["coverage"] == 1
    assert {x["doc_id"] for x in decontam.drop_contaminated(docs_of(spark, rows), bench).collect()} == {3, 5, 6}
    assert decontam.contaminated(none, bench).count() == decontam.contaminated(odd, bench.limit(0)).count() == 0
    assert {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs_of(spark, rows), bench, broadcast=0).collect()} == got.keys()


def brute_tiles(doc, item, least):
    """Greedy string tiling as it is defined: of all longest unmarked matches the first (by place in doc, then item) again and again."""
    free_doc, free_item, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while j + n < len(doc) and i + n < len(item) and doc[j + n] == item[i + n] and free_doc[j + n] and free_item[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        n, j, i = best
        if n < least:
            return tiles
        free_doc[j : j + n], free_item[i : i + n] = [False] * n, [False] * n
        tiles.append((j, i, n))


@pytest.mark.parametrize("seed", range(4))
def test_decontamination_against_brute_force(spark, seed):
    """Rows, coverage, number of tiles and the longest one, by broadcast and by seeds; periodic texts, repeated ids and items."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(6 if seed % 2 else 60)]
    items = [(k % 9, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 5, 8, 20, 45])))) for k in range(12)]
    items += [items[0], (20, "la la la la la la la la"), (21, "w1 w2 w1 w2 w1 w2 w1 w2 w1 w2"), (22, None)]
    rows = []
    for k in range(25):
        w = r.choices([*vocabulary, "x", "y"], k=r.randrange(40))
        for _, t in r.sample(items[:-1], 2):
            q = t.split()
            a = r.randrange(len(q))
            w[r.randrange(len(w) + 1) : 0] = (q[a:] + q[:a]) if r.random() < 0.7 else q[a:]
        rows.append((k % 20, " ".join(w)))
    rows += [(30, "la " * 60), (31, "W1, w2! " * 30), (31, "w1 w2 " * 30), (32, None), (None, rows[0][1])]
    want = []
    for i, t in rows:
        for k, it in items:
            doc, item = decontam.words(t or ""), decontam.words(it or "")
            tiles = brute_tiles(doc, item, min(5, len(item))) if doc and item else []
            covered = sum(n for *_, n in tiles) / len(item) if item else 0
            if tiles and covered >= 0.5:
                want.append((i, k, round(covered, 9), len(tiles), max(n for *_, n in tiles)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for broadcast in (decontam.BROADCAST, 0):
        found = decontam.contaminated(docs_of(spark, rows), bench, broadcast=broadcast).collect()
        assert sorted(((x[0], x[1], round(x[2], 9), x[3], x[4]) for x in found), key=str) == sorted(want, key=str)


def test_periodic_texts_end_soon():
    import time

    item = " ".join(["a b"] * 400)
    began = time.time()
    assert decontam.Items([(1, item)], 5).matches("a b " * 4000, 0.5) == [(0, 1.0, 1, 800)]
    assert time.time() - began < 5


def test_warc(spark):
    rows = [
        (1, "response", "http://www.A.org/x/?b=2&a=1#f", 10, 200, {"etag": '"1"', "age": "0", "content-length": "3"}, "one"),
        (2, "response", "https://a.org/x?a=1&b=2", 20, 200, {"etag": '"2"', "last-modified": "d"}, "two"),
        (3, "response", "https://a.org/x?a=1&b=2", 25, 500, {}, "bad"),
        (4, "revisit", "a", 30, 304, {}, None), (5, "revisit", "http://a.org:80/x?a=1&b=2", 30, 304, {"etag": 'W/"2"', "content-length": "0", "age": "9"}, None),
        (6, "revisit", "http://a.org/x?a=1&b=2", 20, 304, {"etag": '"9"'}, None), (7, "revisit", "http://a.org/x?a=1&b=2", 30, 304, None, None),
        (8, "revisit", None, 30, 304, {}, None), (9, "revisit", "http://a.org/x?a=1&b=2", None, 304, {}, None), (10, "revisit", "http://a.org/x?a=1&b=2", 5, 304, {"etag": '"1"'}, None),
    ]
    data = spark.createDataFrame(rows, "record_id long, kind string, url string, time long, status int, headers map<string,string>, body string")
    for rows_a_slice, share in ((1, 1), (2, 10_000), (500_000, 10_000)):
        got = {r["record_id"]: r for r in warc.resolve(data, rows_a_slice, share).collect()}
        assert {k: (r["state"], r["base_id"]) for k, r in got.items()} == {
            4: ("no_response", None), 5: ("resolved", 2), 6: ("mismatch", 1), 7: ("no_validator", 2), 8: ("no_response", None), 9: ("no_response", None), 10: ("no_response", None),
        }
        assert got[5]["headers"] == {"etag": 'W/"2"', "last-modified": "d", "age": "9"} and got[5]["body"] == "two"
    assert warc.resolve(data.limit(0)).count() == 0


def brute_revisits(rows):
    """(record_id, time) to (state, base_id, body) of every revisit, response by response."""
    out = []
    for i, kind, url, t, _, h, _ in rows:
        if kind != "revisit":
            continue
        before = [x for x in rows if x[1] == "response" and x[4] == 200 and None not in (x[0], x[2], x[3], t) and x[2] == url and x[3] < t]
        base = max(before, key=lambda x: (x[3], x[0], x[6] is not None, x[6] or "", sorted((x[5] or {}).items())), default=None)
        h, old = h or {}, (base[5] or {}) if base else {}
        state = "no_response" if base is None else next(
            (("resolved" if h[k] == old[k] else "mismatch") for k in ("etag", "last-modified") if k in h and k in old), "no_validator")
        out.append((i, t, state, base and base[0], base[6] if state == "resolved" else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_warc_against_brute_force(spark, seed):
    """A hot URL, repeated ids and rows, ties in time, one absurd time, nulls and extra columns with clashing names."""
    r = random.Random(seed)
    rows = []
    for _ in range(250):
        kind = r.choice(["response", "revisit"])
        url = r.choice(["http://hot.org/a"] * 6 + ["http://b.org/b", "http://c.org/c", None])
        t = r.choice([r.randrange(60), r.randrange(60), 10**15, None] if r.random() < 0.2 else [r.randrange(60)])
        headers = r.choice([None, {}, {"etag": f'"{r.randrange(3)}"'}, {"last-modified": f"d{r.randrange(3)}"}])
        rows.append((r.choice([None, r.randrange(40), r.randrange(40)]), kind, url, t, r.choice([200, 200, 404]), headers, r.choice([None, "x", "y", ""])))
    rows += rows[:40]
    data = spark.createDataFrame([(*x, "s", 1, 2) for x in rows], "record_id long, kind string, url string, time long, status int, headers map<string,string>, body string, slice string, copy long, base_id long")
    for rows_a_slice, share in ((7, 3), (500_000, 10_000)):
        got = warc.resolve(data, rows_a_slice, share).collect()
        want = brute_revisits(rows)
        assert sorted(((x["record_id"], x["state"], x["base_id"], x["body"]) for x in got), key=str) == sorted(((i, *x) for i, _, *x in want), key=str)


def test_secrets(spark, odd, none):
    r = random.Random(3)
    token = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=44))
    texts = [
        'é password = "hunter22" Token:abc API_KEY=' + "f0" * 13, "AKIA" + "ABCDEFGH12345678Z tail", "x" * 3 + "0123456789abcdef" * 3, token, None, "",
        "secret=token: abcdefgh", "passwordpassword: 'a=b=c=d' token==aaaaaa", f"see {token}, aaaaaaaaaaaaaaaaaaaa1111111111111111111111",
    ]
    got = {x["doc_id"]: x for x in secrets.report(secrets.scan(docs_of(spark, list(enumerate(texts))))).collect()}
    base = (
        re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
    )
    for i, t in enumerate(texts):
        found = []
        for k, pattern in enumerate(base):
            for m in pattern.finditer(t or ""):
                if len(m.group(2)) >= 6 if k == 0 else m.end() - m.start() >= (20, 24)[k - 1]:
                    found.append((m.start(), k, m.end()))
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), t
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))
    assert got[3]["spans"] == "random:0:44"
    assert "random" in got[8]["spans"] and not got[8]["spans"].endswith(":90")
    assert secrets.scan(none).count() == 0 and secrets.scan(odd).count() == len(ODD)


def tricky_texts():
    r = random.Random(8)
    fixed = ["", " ", "  a", " a b ", "a\n b", "<s> </s> <|endoftext|>", "▁x ▁▁", "\x00\t", "é 😀", "=" * 400, "ab" * 999, LONG[:3000], "don't  we'll ", "　x y"]
    return fixed + ["".join(r.choices("abcdefgh etionsu  é中\n\t.'1", k=r.randrange(300))) for _ in range(200)]


def test_token_counts(spark, odd, none):
    import sentencepiece

    path = queries._tokenizer("piece_bpe_32k.model")
    texts = tricky_texts()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in token_count.count_tokens(docs_of(spark, list(enumerate(texts))), path).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(x) for x in library.encode(texts, num_threads=1)]
    assert [got[i]["n_bytes"] for i in range(len(texts))] == [len(t.encode()) for t in texts]
    assert token_count.count_tokens(odd, path).count() == len(ODD) and token_count.count_tokens(none, path).count() == 0


def check_packing(rows, texts, ids_of):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids = [*ids_of(t or ""), 0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in pieces] == packing.cut(len(ids))
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    return len(by_sequence)


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries._tokenizer("byte_bpe_50k.json"))
    r = random.Random(1)
    texts = dict(enumerate([*tricky_texts(), None, LONG[:60_000], *(LONG[: r.randrange(9000)] for _ in range(300))]))
    rows = queries.packed(docs_of(spark, list(texts.items()))).collect()
    used = check_packing(rows, texts, lambda t: library.encode(t, add_special_tokens=False).ids)
    assert used <= -(-sum(x["length"] for x in rows) // packing.CAPACITY) + 1
    assert queries.packed(none).count() == 0 and queries.packed(odd).select("doc_id").count() >= len(ODD)


def valid(lengths, bins):
    assert (bins >= 0).all() and len(bins) == len(lengths) and np.bincount(bins, lengths).max() <= packing.CAPACITY


def test_genetic_packing():
    r = np.random.default_rng(0)
    lengths = r.integers(300, 1100, 400)
    first = packing.first_packing(lengths)
    best = packing.evolve(lengths, [first], 1)
    for p in best:
        valid(lengths, p)
    assert packing.lower_bound(lengths) <= best[0].max() + 1 < first.max() + 1
    child = packing.crossover(lengths, first, best[0], r)
    valid(lengths, child)
    for _ in range(30):
        child = packing.mutate(lengths, child, r)
        valid(lengths, child)
    # whole bins of the second parent are in the child, as they are
    child = packing.crossover(lengths, first, best[0], np.random.default_rng(3))
    groups = lambda p: {frozenset(np.flatnonzero(p == b).tolist()) for b in set(p.tolist())}
    assert len(groups(child) & groups(best[0])) > 10


def test_genetic_packing_reaches_known_optima(spark):
    """Pieces cut from full sequences: best-fit decreasing misses their number, the islands reach it."""
    r = np.random.default_rng(5)
    lengths = []
    for _ in range(150):
        a = int(r.integers(520, 900))
        b = int(r.integers(420, (2048 - a) // 2 + 100))
        lengths += [a, b, 2048 - a - b]
    lengths = np.array(lengths)
    before = packing.first_packing(lengths).max() + 1
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "uid long, length long")
    rows = packing.pack_blocks(items, 1).collect()
    used = len({r["bin"] for r in rows})
    assert sorted(r["uid"] for r in rows) == list(range(450)) and 150 <= used <= 152 < before
    fill = defaultdict(int)
    for x in rows:
        fill[x["bin"]] += x["length"]
    assert max(fill.values()) <= packing.CAPACITY


@pytest.mark.parametrize(("operator", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, odd, none, operator, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = operator.score(docs, labels).toPandas()
    assert len(scored) == docs.count() and scored.score.between(0, 1).all()
    m = scored.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m[label]).mean() >= 0.9
    empty = labels.limit(0)
    assert operator.score(none, empty).count() == 0
    assert operator.score(odd, empty).where("score IS NULL").count() == 0
    assert operator.score(odd, labels).count() == len(ODD)


def test_pipeline(spark, odd, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {n: None for n, _ in corpus_pipeline.STAGES}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    left = {r["doc_id"] for r in rows}
    bad = {r["doc_id"] for r in toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    first = {}
    for i in sorted(texts.keys() - bad):
        first.setdefault(re.sub("[\x20\t-\r]+", " ", texts[i]), i)
    near = {i for i, (_, c) in brute_components([(i, texts[i]) for i in first.values()]).items() if i == c}
    leaks = {r["doc_id"] for r in decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert left == near - leaks and list(kept) == [n for n, _ in corpus_pipeline.STAGES]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.limit(0), sf_dir).columns == odd.columns


def test_driver_gives_freed_memory_back(spark, monkeypatch):
    """The pipeline was stopped for its driver's memory, of which a good part was native heap that the JVM had freed."""
    assert common.ease(spark)
    eased = []
    monkeypatch.setattr(ngram_join, "ease", lambda s: eased.append(common.ease(s)))
    monkeypatch.setattr(toxicity, "ease", lambda s: eased.append(common.ease(s)))
    docs = docs_of(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")])
    assert {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()} == {1: 1, 2: 1, 3: 3}
    n = len(eased)
    toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert n >= 3 and len(eased) > n and all(eased)
