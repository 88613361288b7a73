"""The randomness battery against plain Python, false-discovery control, planted tokens, long tokens and texts."""

import math
import random
import time
from collections import Counter

import pytest

from ravelin.llm import secrets

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def chi_squared(codes, k, width):
    n, bins = len(codes), math.ceil(k / width)
    off = 0.0
    for b in range(bins):
        expected = n * min(width, k - b * width) / k
        off += (sum(math.floor(c / width) == b for c in codes) - expected) ** 2 / expected
    df = bins - 1
    return tail(((off / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def brute_p(token):
    kind = next(n for n, ok in (("decimal", token.isdigit()), ("hex", not token.strip("0123456789abcdef") or not token.strip("0123456789ABCDEF")),
                                ("base32", not set(token) - set("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")), ("upper", token.isalnum() and token == token.upper()), ("base64", True)) if ok)
    plain = token.rstrip("=").replace("-", "+").replace("_", "/")
    alphabet = secrets.ALPHABETS[kind]
    codes = [alphabet.find(c) for c in (plain.lower() if kind == "hex" else plain)]
    k, n = len(alphabet), len(codes)
    equal = k / max(m for m in range(2, 65) if k % m == 0 and (m <= n / 2.5 or m == 2))
    high = [c >= k / 2 for c in codes]
    n1, runs = sum(high), 1 + sum(x != y for x, y in zip(high, high[1:]))
    if n1 in (0, n):
        of_runs = 0.0
    else:
        both = 2 * n1 * (n - n1)
        of_runs = 2 * tail(abs(runs - both / n - 1) / math.sqrt(max(both * (both - n) / (n * n * (n - 1)), 1e-9)))
    mean = sum(codes) / n
    spread = sum((c - mean) ** 2 for c in codes)
    lagged = sum((x - mean) * (y - mean) for x, y in zip(codes, codes[1:]))
    serial = 2 * tail(abs(lagged / max(spread, 1e-9) + 1 / n) * math.sqrt(n)) if spread else 0.0
    return min(1.0, 4 * min(chi_squared(codes, k, equal), chi_squared(codes, k, 13.0 if k == 64 else min(k / 2, 10.0)), of_runs, serial))


def test_randomness_against_plain_python(spark):
    r = random.Random(2)
    alphabets = [*secrets.ALPHABETS.values(), "0123456789ABCDEF", "ab1", "abcdefghij_-="]
    tokens = ["".join(r.choices(a, k=r.choice([20, 21, 33, 64, 200]))) for a in alphabets for _ in range(12)]
    tokens += ["a" * 20, "1" * 30, "user_name_2024_report", "A1" * 30, "=" * 20 + "a1", "0123456789abcdef" * 3]
    tokens = [t for t in tokens if t.rstrip("=")]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.p_value(secrets.F.col("t")).alias("p")).collect()
    for x in got:
        assert x["p"] == pytest.approx(brute_p(x["t"]), rel=1e-3, abs=1e-6), x["t"]


def test_false_discovery_control_bounds_what_is_reported():
    """Against a plain step-up over the single p-values of each length class."""
    r = random.Random(4)
    nulls = {(k, f, s): Counter(r.randrange(20, 90) for _ in range(400)) for k in ("hex", "base64") for f in "ab" for s in range(len(secrets.LENGTHS))}
    p = secrets.tails(nulls)
    assert all(x <= y for cells in p.values() for x, y in zip(cells, cells[1:]))
    for (k, f, s), cells in nulls.items():  # never below the share of any form
        for c in (0, 30, 60, 89):
            assert p[k, s][c] >= sum(n for x, n in cells.items() if x <= c) / 400
    counts = Counter((r.choice(["hex", "base64"]), r.randrange(3), r.choice([r.randrange(12), r.randrange(20, 90)])) for _ in range(900))
    cut = secrets.cutoffs(counts, p)
    for s in range(len(secrets.LENGTHS)):
        every = sorted(p[k, t][c] for (k, t, c), n in counts.items() if t == s for _ in range(n))
        passed = [i for i, x in enumerate(every, 1) if x <= secrets.Q * i / len(every)]
        reported = sum(n for (k, t, c), n in counts.items() if t == s and c <= cut[k, s])
        assert reported == (max(passed) if passed else 0)
    assert set(cut) == set(p) and max(cut[k, s] for k in ("hex", "base64") for s in range(3)) > 0


NATO = """alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor
whiskey xray yankee zulu garden window bottle orange silver yellow purple monkey rabbit kitchen bedroom ceiling harbor island mountain valley""".split()


def test_planted_tokens_by_length(spark):
    """Word tokens, of words that the null does not know, are rarely reported; random ones are found from 32 characters on."""
    r, rows, kinds = random.Random(1), [], []
    for size in (20, 24, 32, 44, 64):
        for _ in range(60):
            for kind, joint in (("random", None), ("words", "_"), ("words", "-"), ("words", "")):
                parts = [r.choice(NATO) for _ in range(12)]
                parts.insert(r.randrange(1, 3), str(r.randrange(100, 9999)))
                token = "".join(r.choices(B64, k=size - 1)) + "7" if kind == "random" else joint.join(p if joint else p.capitalize() for p in parts)[: size - 1] + "4"
                rows.append((len(rows), f"see {token} end"))
                kinds.append((kind, size))
    found, every = Counter(), Counter(kinds)
    for x in secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        found[kinds[x["doc_id"]]] += "random" in x["spans"]
    reported = sum(found.values())
    assert sum(n for (kind, _), n in found.items() if kind == "words") <= 0.1 * reported
    for size in (20, 24):
        assert found["words", size] <= 0.1 * every["words", size]
    for size, least in ((24, 0.4), (32, 0.8), (44, 0.9), (64, 0.9)):
        assert found["random", size] >= least * every["random", size], size


def test_long_tokens_and_many_tokens_end_soon(spark):
    r = random.Random(3)
    pieces = ["".join(r.choices(B64, k=23)) + "5" for _ in range(20_000)]
    rows = [(1, "".join(r.choices(B64, k=100_000))), (2, " ".join(pieces)), (3, " ".join(f"token={p}" for p in pieces)), (4, "a1" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {x["doc_id"]: x for x in secrets.report(secrets.scan(docs)).collect()}
    assert time.time() - began < 60
    assert got[1]["spans"] == "random:0:100000" and got[4]["spans"] in ("", "hex:0:100000")
    spans = [s.split(":") for s in got[2]["spans"].split(",")]
    assert len(spans) > 10_000 and all(int(a) % 25 == 0 and int(b) - int(a) == 24 for k, a, b in spans if k == "random")
    assert got[3]["n_assign"] == 20_000 and "random" not in got[3]["spans"]
    assert got[3]["spans"].startswith("assign:0:30,assign:31:61,")


def test_random_spans_inside_base_spans_are_left_out(spark):
    r = random.Random(5)
    token = "".join(r.choices(B64, k=60))
    texts = [f"token={token}", f"{token} token=abcdefgh", f"token={token}.x {token}"]
    got = {x["doc_id"]: x["spans"] for x in secrets.report(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert got == {0: "assign:0:66", 1: "random:0:60,assign:61:75", 2: "assign:0:68,random:69:129"}
