r"""Secret scan: fixed base patterns plus a randomness test battery, in built-in functions only.

Base spans come from three patterns. Further candidates are maximal runs of 20 or more characters of
``[A-Za-z0-9+/_=-]`` with a letter and a digit. For each its encoding is inferred (decimal, hex,
base32, upper-case alphanumeric, base64), and three tests of the hypothesis "uniformly random over
that alphabet" are made: chi-squared uniformity (over as many equal bins as the length allows, and over
bins that end with the letter cases), runs above and below the alphabet's middle, and lag-one serial
correlation. Four times the smallest p-value (Bonferroni over dependent tests), at most 1, is the token's
randomness.

Length-aware false-discovery control is on what is reported. Structured text is the null hypothesis:
its randomness is measured on NULLS made identifiers of each form (words, numbers and separators, camel
case, counters, repeated blocks), encoding and length class, cut to the class's least length, where they look
most random. A token's p-value is the share of these that look as random as it does, or, where that is
larger, the normal tail fitted to the root of their -log10; of several forms the largest counts.
Benjamini-Hochberg over all candidates of
the corpus in each length class then bounds the expected share of structured text among the reported
tokens at Q. Short structured tokens look nearly random, so short random ones are partly missed.

Randomness is counted on a grid of encodings x LENGTHS x GRID cells (at most 14,035 numbers), which is
all that the driver ever sees. Every step is linear in the text and in a token's length, but for the
places of the matches of a text, which are summed in log2(matches) passes.

Defined cases: a null text is empty; every row gives one row, repeated ids too; overlapping base
spans of different kinds all stay, a random span within a base span is left out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_of

# The contract's patterns (group 2 of the first is the value).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

#: Level of the false-discovery control, lower ends of the length classes, cells of -20 log10 p, identifiers made for each form and class.
Q, LENGTHS, GRID, NULLS = 0.05, (20, 24, 28, 32, 40, 48, 64), 401, 500

# Alphabets in the order of their digits; sizes and their divisors (numbers of equal bins).
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


# Words of identifiers.
WORDS = (
    "user", "name", "account", "session", "config", "value", "index", "order", "total", "price", "file", "path", "image", "thumb", "large", "small",
    "created", "updated", "delete", "insert", "table", "column", "number", "report", "monthly", "summary", "customer", "product", "version", "release",
    "north", "south", "market", "street", "article", "section", "header", "footer", "button", "primary", "default", "enabled", "request", "response",
    "server", "client", "handler", "manager", "factory", "builder", "system", "process", "network", "message", "channel", "country", "project", "issue",
)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, both) -> Column:
    """Inclusive scan of an array of integers by ``both`` in log2(size) passes; a concatenated array a step would be quadratic."""
    def double(acc: Column, step: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= step, both(x, F.get(acc, F.greatest(i - step, F.lit(0))))).otherwise(x))

    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30)]), lambda step: step < F.size(values))
    return F.aggregate(steps, values, double)


def located(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all leftmost non-overlapping matches: array of struct(start, kind, end, token).

    Spark gives matches and the gaps between them, but no positions; they add up from the lengths.
    """
    entry = "array<struct<start:int,kind:int,end:int,token:string>>"

    def placed(s: Column) -> Column:
        sizes = F.zip_with(F.slice(s["gaps"], F.lit(1), F.size(s["found"])), s["found"], lambda g, m: F.length(g) + F.length(m))
        return let(running(sizes, lambda x, y: x + y), lambda ends: F.zip_with(ends, s["found"], one))

    def one(end: Column, match: Column) -> Column:
        return F.struct((end - F.length(match)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), match.alias("token"))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast(entry))


def base_spans(text: Column) -> Column:
    """The contract's spans, unsorted; an assigned value needs 6 characters or more."""
    value = lambda x: F.regexp_extract(x["token"], ASSIGN, 2)
    assign = F.filter(located(text, ASSIGN, 0), lambda x: F.length(value(x)) >= 6)
    return F.concat(assign, located(text, ACCESS, 1), located(text, HEX, 2))


def upper_tail(z: Column) -> Column:
    """Of the standard normal, for z >= 0 (rational approximation, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9]+$"), "decimal").when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32").when(token.rlike("^[A-Z0-9]+$"), "upper").otherwise("base64")
    )


def p_value(token: Column) -> Column:
    """Randomness: of the hypothesis that the token is uniformly random over its inferred alphabet."""
    return let(F.struct(token.alias("t"), encoding(token).alias("kind")), _p_of)


def _p_of(x: Column) -> Column:
    token, kind = x["t"], x["kind"]
    plain = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    digits, sizes = F.lit(None), F.lit(None)
    for name, alphabet in ALPHABETS.items():
        place = F.array(*[F.lit(alphabet.find(chr(c))) for c in range(128)])
        digits, sizes = F.when(kind == name, place).otherwise(digits), F.when(kind == name, F.lit(len(alphabet))).otherwise(sizes)

    def coded(y: Column) -> Column:
        codes = F.transform(F.filter(F.split(y["symbols"], ""), lambda c: c != ""), lambda c: F.get(y["digits"], F.ascii(c)).cast("double"))
        return F.struct(codes.alias("c"), y["k"].alias("k"), F.greatest(F.length(y["symbols"]), F.lit(2)).cast("double").alias("n"))

    made = F.struct(F.when(kind == "hex", F.lower(plain)).otherwise(plain).alias("symbols"), digits.alias("digits"), sizes.cast("double").alias("k"))
    tests = lambda s: F.least(F.lit(1.0), 4 * F.least(_uniform(s, _equal(s)), _uniform(s, _classes(s)), _runs(s), _serial(s)))
    return let(made, lambda y: let(coded(y), tests))


def _uniform(s: Column, width: Column) -> Column:
    """Chi-squared over bins of ``width`` neighbouring digits; the last bin may be narrower."""
    def binned(w: Column) -> Column:
        at = F.transform(s["c"], lambda x: F.floor(x / w).cast("int"))
        return F.struct(F.ceil(s["k"] / w).cast("int").alias("bins"), w.alias("w"), s["n"].alias("n"), s["k"].alias("k"), at.alias("at"))

    def counted(x: Column) -> Column:
        expected = lambda b: x["n"] * F.least(x["w"], x["k"] - b * x["w"]) / x["k"]
        of_bin = lambda b: F.size(x["at"]) - F.size(F.array_remove(x["at"], b))
        off = F.aggregate(F.sequence(F.lit(0), x["bins"] - 1), F.lit(0.0), lambda acc, b: acc + F.pow(of_bin(b) - expected(b), 2) / expected(b))
        return F.struct(off.alias("off"), (x["bins"] - 1).cast("double").alias("df"))

    def tail(y: Column) -> Column:
        z = (F.cbrt(y["off"] / y["df"]) - (1 - 2 / (9 * y["df"]))) / F.sqrt(2 / (9 * y["df"]))
        return F.when(z >= 0, upper_tail(z)).otherwise(1 - upper_tail(-z))

    return let(let(let(width, binned), counted), tail)


def _equal(s: Column) -> Column:
    """Width of as many equal bins as leave 2.5 symbols each, two at least."""
    k, n = s["k"], s["n"]
    return k / F.array_max(F.filter(F.sequence(F.lit(2), F.lit(64)), lambda m: (k % m == 0) & ((m <= n / 2.5) | (m == 2))))


def _classes(s: Column) -> Column:
    """Width of bins that end where letter cases and digits of base64 do; ten for the other alphabets."""
    return F.when(s["k"] == 64, 13.0).otherwise(F.least(s["k"] / 2, F.lit(10.0)))


def _runs(s: Column) -> Column:
    def of(x: Column) -> Column:
        high, n = x["high"], x["n"]
        runs = 1 + F.size(F.filter(high, lambda v, i: (i > 0) & (v != F.get(high, F.greatest(i - 1, F.lit(0))))))
        return F.struct(F.aggregate(high, F.lit(0), lambda a, v: a + v).cast("double").alias("n1"), runs.alias("runs"), n.alias("n"))

    def tail(x: Column) -> Column:
        n1, n = x["n1"], x["n"]
        both = 2 * n1 * (n - n1)
        z = F.abs(x["runs"] - both / n - 1) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        return F.when((n1 == 0) | (n1 == n), 0.0).otherwise(2 * upper_tail(F.least(z, F.lit(38.0))))

    high = F.transform(s["c"], lambda x: (x >= s["k"] / 2).cast("int"))
    return let(let(F.struct(high.alias("high"), s["n"].alias("n")), of), tail)


def _serial(s: Column) -> Column:
    def tail(x: Column) -> Column:
        off, n = x["off"], x["n"]
        spread = F.aggregate(off, F.lit(0.0), lambda a, v: a + v * v)
        lagged = F.aggregate(F.transform(off, lambda v, i: F.when(i > 0, v * F.get(off, F.greatest(i - 1, F.lit(0)))).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
        z = F.abs(lagged / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        return F.when(spread == 0, 0.0).otherwise(2 * upper_tail(F.least(z, F.lit(38.0))))

    mean = F.aggregate(s["c"], F.lit(0.0), lambda a, x: a + x) / s["n"]
    off = let(mean, lambda m: F.transform(s["c"], lambda x: x - m))
    return let(F.struct(off.alias("off"), s["n"].alias("n")), tail)


def cell(p: Column) -> Column:
    """The grid cell of a p-value; its upper end is 10 ** (-cell / 20)."""
    return F.least(F.floor(-20 * F.log10(F.greatest(p, F.lit(1e-30)))), F.lit(GRID - 1)).cast("int")


def length_class(n: Column) -> Column:
    return sum(((n >= low).cast("int") for low in LENGTHS[1:]), F.lit(0))


def identifiers(spark: SparkSession, each: int = NULLS) -> DataFrame:
    """kind, form, stratum, token: made structured tokens, ``each`` of every form and length class."""
    i = F.col("id")
    draw = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n)).cast("int")
    words = F.array(*[F.lit(w) for w in WORDS])
    chosen = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.get(words, F.pmod(F.xxhash64(i, j), F.lit(len(WORDS))).cast("int")))
    number = F.pmod(F.xxhash64(i, F.lit("number")), F.pow(F.lit(10), 1 + draw("digits", 4)).cast("long")).cast("string")
    parts = F.concat(F.slice("chosen", F.lit(1), 1 + draw("place", 3)), F.array(number), F.slice("chosen", F.lit(5), F.lit(12)))
    joined = F.array_join("parts", "")
    capital = F.array_join(F.transform("parts", F.initcap), "")
    separator = F.get(F.array(*[F.lit(x) for x in "_-/"]), draw("separator", 3))
    forms = {
        ("base64", "words"): F.substring(F.array_join(F.transform("parts", lambda p: F.concat(separator, p)), ""), 2, 80), ("base64", "camel"): capital,
        ("upper", "words"): F.upper(joined), ("base32", "words"): F.translate(F.upper(joined), "0189", "2345"),
        ("hex", "counter"): F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(i), F.lit(1 << 24)))), 64, "0"),
        ("hex", "blocks"): F.repeat(F.substring(F.md5(i.cast("string")), 1, 4), 16), ("decimal", "blocks"): F.repeat(number, 64),
    }
    made = spark.range(each).select("id", chosen.alias("chosen")).select("id", parts.alias("parts")).select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("form"), t.alias("long")) for (k, f), t in forms.items()])).alias("x")
    ).select("x.*", F.explode(F.array(*[F.lit(n) for n in LENGTHS])).alias("size"))
    cut = F.when(F.col("form") == "counter", F.expr("right(long, size)")).otherwise(F.expr("left(long, size)"))
    return made.select("kind", "form", length_class(F.col("size")).alias("stratum"), cut.alias("token"))


def tails(nulls: dict[tuple[str, str, int], dict[int, int]]) -> dict[tuple[str, int], list[float]]:
    """For each encoding and length class the p-value of every cell: how probably structured text looks as random or more.

    The null hypothesis is composite: of the forms of an encoding the one that looks most random counts.
    """
    out: dict[tuple[str, int], list[float]] = {}
    for (kind, _, stratum), cells in nulls.items():
        n = sum(cells.values())
        mean = sum(math.sqrt(c / 20) * k for c, k in cells.items()) / n
        spread = math.sqrt(max(sum((math.sqrt(c / 20) - mean) ** 2 * k for c, k in cells.items()) / n, 0.01))
        seen, p = 0, []
        for c in range(GRID):
            seen += cells.get(c, 0)
            p.append(max(seen / n, math.erfc((mean - math.sqrt(c / 20)) / spread / math.sqrt(2)) / 2))
        out[kind, stratum] = [max(x, y) for x, y in zip(p, out.get((kind, stratum), p), strict=True)]
    return out


def cutoffs(counts: dict[tuple[str, int, int], int], tail: dict[tuple[str, int], list[float]], q: float = Q) -> dict[tuple[str, int], int]:
    """For each encoding and length class the largest cell that is reported, -1 for none (Benjamini-Hochberg within a length class)."""
    out = dict.fromkeys(tail, -1)
    for stratum in range(len(LENGTHS)):
        found = sorted((tail[kind, s][c], n) for (kind, s, c), n in counts.items() if s == stratum)
        total, seen, level = sum(n for _, n in found), 0, -1.0
        for at, (p, n) in enumerate(found):
            seen += n
            if (at + 1 == len(found) or found[at + 1][0] > p) and p <= q * seen / total:
                level = p
        for kind, s in out:
            if s == stratum:
                out[kind, s] = sum(p <= level for p in tail[kind, s]) - 1
    return out


def _grid(rows: DataFrame, *by: str) -> dict[tuple, int]:
    """Tokens by these columns and cell: a bounded number of rows."""
    return {tuple(r)[:-1]: r["count"] for r in rows.groupBy(*by, "cell").count().collect()}


def scan(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id and ``found``, the sorted spans (start, kind, end) of every row."""
    text = text_of()
    mixed = lambda x: x["token"].rlike("[A-Za-z]") & x["token"].rlike("[0-9]")
    tested = F.transform(
        F.filter(located(text, CANDIDATE, 3), mixed),
        lambda x: F.struct(
            x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), encoding(x["token"]).alias("code"),
            length_class(F.length(x["token"])).alias("stratum"), cell(p_value(x["token"])).alias("cell"),
        ),
    )
    bare = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    spans = materialize(docs.select("doc_id", F.transform(base_spans(text), bare).alias("base"), tested.alias("tested")), "spans")
    nulls: dict[tuple[str, str, int], dict[int, int]] = {}
    made = identifiers(docs.sparkSession).select("kind", "form", "stratum", cell(p_value(F.col("token"))).alias("cell"))
    for (*key, c), n in _grid(made, "kind", "form", "stratum").items():
        nulls.setdefault(tuple(key), {})[c] = n
    found = spans.select(F.explode("tested").alias("t")).select(F.col("t.code").alias("kind"), "t.stratum", "t.cell")
    cut = cutoffs(_grid(found, "kind", "stratum"), tails(nulls), q)
    limits = F.create_map(*[F.lit(v) for key in ALPHABETS for v in (key, [cut[key, s] for s in range(len(LENGTHS))])])
    random = F.transform(F.filter("tested", lambda x: x["cell"] <= F.get(F.try_element_at(limits, x["code"]), x["stratum"])), bare)
    return spans.select("doc_id", _outermost(F.sort_array(F.concat("base", random))).alias("found"))


def _outermost(spans: Column) -> Column:
    """Sorted spans without the random ones that lie in a base span: those whose end the base spans before them reach."""
    def keep(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), F.greatest)
        return let(ends, lambda m: F.filter(all_, lambda x, i: (x["kind"] < 3) | (x["end"] > F.get(m, i))))

    return let(spans, lambda a: F.when(F.exists(a, lambda x: x["kind"] == 3), let(a, keep)).otherwise(a))


def report(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`scan`."""
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    number = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(joined(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )
