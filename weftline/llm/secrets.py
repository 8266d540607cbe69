"""Secret scans: base patterns, and a randomness test battery for what they miss. Column expressions only.

The battery takes every run of 16 or more characters of an encoded alphabet that has a letter, infers its encoding (hex, base32, base36, base62, base64) and
measures how far it is from symbols that are independent and uniform over that alphabet:

- chi-squared of the symbol counts, and of the counts of the alphabet's classes (capitals, small letters, digits, signs), as normal values by the cube root;
- runs: changes from one class to another, against their mean and variance in a random run;
- serial correlation of neighbouring symbols.

The root of the sum of their squares is a run's distance. Of a random run it does not depend on the length; of words, identifiers and paths it grows with
the root of the length. So both sides are controlled: a run is reported if its distance is not too great for a random one (level RANDOM), and if the hypothesis
that it is made of words is rejected. The p-value of that is the lower tail of the distance of words at that length (WORDS), and the Benjamini-Hochberg
procedure over all runs of the corpus, with weights that grow with length, keeps the share of words among what is reported under FDR. p-values are
rounded up to STEPS a power of ten, so the corpus is one histogram of lengths and p-values, of bounded size. Runs that a base span covers are not reported.
Not told from words: runs of digits only, which are numbers, and short runs of one case without digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import spans
from weftline.llm.shared import written

KINDS = ("assign", "access", "hex", "random")

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
#: Runs of 16 characters or more, and of 32 or more: a run is a match or fails as a whole.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: Runs that the battery tests: what stands before and after a span of kind hex, which is a match of its own here and not tested. What a match begins with is
#: looked at first, which decides nothing but passes words in half the time.
CANDIDATE = r"(?=[A-Za-z0-9+/_-]{16})(?:[0-9a-f]{32,}|(?:(?![0-9a-f]{32})[A-Za-z0-9+/_-]){16,}+={0,2})"
FDR, RANDOM = 0.05, 1e-4
#: The distance of words at length n: mean WORDS[0] * sqrt(n), deviation WORDS[1]. Calibrated on identifiers of some 200 programming words in seven styles
#: (camel case with and without a capital first and with numbers, snake, kebab, upper snake, paths): their tails are not heavier at lengths of 16 to 128.
WORDS = (1.25, 1.4)
#: Steps of p-values in a power of ten, powers of ten, and the length from which weights don't grow.
STEPS, POWERS, LONGEST = 50, 15, 256
#: Encodings' symbols in order, by their number; hex and base36 in lower case.
_ALPHABETS = {
    16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "abcdefghijklmnopqrstuvwxyz0123456789",
    62: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Symbols of each class, in the order of the alphabet.
_CLASSES = {16: (10, 6), 32: (26, 6), 36: (26, 10), 62: (26, 26, 10), 64: (26, 26, 10, 2)}


def _found(kind: str, keep=None) -> Column:
    """Spans of a kind from the columns of its matches and gaps: start, end and the place of the kind in the list; keep: of the matches, which count."""
    match, gap = F.col(f"{kind}_match"), F.col(f"{kind}_gap")
    order = KINDS.index(kind)
    located = F.transform(F.arrays_zip(spans.starts(gap, match).alias("at"), match.alias("m")), lambda s: F.struct(
        s["at"].alias("start"), F.lit(order).alias("rank"), (s["at"] + F.length(s["m"])).alias("end"), s["m"].alias("match")))
    if keep is not None:
        located = F.filter(located, keep)
    return F.when(F.size(match) > 0, located)


def _by_encoding(k: Column, value: Callable[[int], float]) -> Column:
    out = F.lit(value(64))
    for size in (62, 36, 32, 16):
        out = F.when(k == size, value(size)).otherwise(out)
    return out


def _encoding(run: Column) -> Column:
    """The size of the alphabet of the encoding that a run seems to have."""
    body = F.regexp_replace(run, "=+$", "")
    return (
        F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(body.rlike("^[A-Z2-7]+$"), 32).when(body.rlike("^([A-Z0-9]+|[a-z0-9]+)$"), 36)
        .when(body.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64)
    )


def _plain(run: Column, k: Column) -> Column:
    """The run in its alphabet's letters."""
    body = F.regexp_replace(run, "=+$", "")
    return F.when(k.isin(16, 36), F.lower(body)).otherwise(F.translate(body, "-_", "+/"))


def _numbers(plain: Column, k: Column) -> Column:
    """Symbols as numbers from 0."""
    alphabet = F.lit(_ALPHABETS[64])  # base32 and base62 begin alike, but for base32's digits
    for size in (36, 32, 16):
        alphabet = F.when(k == size, _ALPHABETS[size]).otherwise(alphabet)
    return F.transform(F.split(plain, ""), lambda c: F.position(c, alphabet).cast("int") - 1)


def _class(v: Column, k: Column) -> Column:
    low = F.when(v < 26, 0).when(v < 52, 1).when(v < 62, 2).otherwise(3)
    return F.when(k == 16, F.when(v < 10, 0).otherwise(1)).when(k.isin(32, 36), F.when(v < 26, 0).otherwise(1)).otherwise(low)


def _counts(x: Column, k: Column) -> list[Column]:
    """What the tests need: squared symbol counts, class counts, changes of class, and the sum of neighbours' products."""
    middle = (k - 1) / 2
    pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # sorted, a symbol's copies lie together: each copy adds as many as the copies up to it, twice less one
    squares = F.aggregate(
        F.array_sort(x), F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("run"), F.lit(-1).alias("of")),
        lambda a, v: F.struct((a["sum"] + F.when(a["of"] == v, 2 * a["run"] + 1).otherwise(1.0)).alias("sum"), F.when(a["of"] == v, a["run"] + 1).otherwise(1.0).alias("run"), v.alias("of")),
        lambda a: a["sum"],
    )
    of_class = lambda c: F.size(F.filter(x, lambda v: _class(v, k) == c)).cast("double").alias(f"c{c}")
    return [
        F.size(x).cast("double").alias("n"), k.alias("k"), squares.alias("squares"), *map(of_class, range(4)),
        F.size(F.filter(pairs, lambda p: _class(p["a"], k) != _class(p["b"], k))).cast("double").alias("changes"),
        F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - middle) * (p["b"] - middle)).alias("products"),
    ]


def _normal(chi: Column, free: Column) -> Column:
    """A chi-squared value as a normal one; below its mean it is 0: too even is for the other tests."""
    spread = F.lit(2.0) / (F.lit(9.0) * free)
    return F.greatest(F.lit(0.0), (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1.0 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread))


def _change(size: int) -> tuple[float, float]:
    """Of two neighbours of a random run, the probability of different classes; of two such pairs with one symbol in common, the covariance."""
    shares = [c / size for c in _CLASSES[size]]
    two, three = sum(q * q for q in shares), sum(q**3 for q in shares)
    return 1 - two, 1 - 2 * two + three - (1 - two) ** 2


def _distance(t: Column) -> Column:
    n, k = t["n"], t["k"].cast("double")
    uniform = _normal(t["squares"] * k / n - n, k - 1)
    share = lambda c: _by_encoding(t["k"], lambda size: (_CLASSES[size][c] if c < len(_CLASSES[size]) else 0) / size)
    of_classes = sum((F.when(share(c) > 0, t[f"c{c}"] * t[f"c{c}"] / (n * share(c))).otherwise(0.0) for c in range(4)), F.lit(0.0)) - n
    classes = _normal(of_classes, _by_encoding(t["k"], lambda size: len(_CLASSES[size]) - 1.0))
    change, both = _by_encoding(t["k"], lambda size: _change(size)[0]), _by_encoding(t["k"], lambda size: _change(size)[1])
    runs = (t["changes"] - (n - 1) * change) / F.sqrt((n - 1) * change * (F.lit(1.0) - change) + 2 * (n - 2) * both)
    serial = t["products"] / ((k * k - 1) / 12 * F.sqrt(n - 1))  # with the alphabet's own mean and variance
    return F.sqrt(uniform * uniform + classes * classes + runs * runs + serial * serial)


def _step(d: Column, n: Column) -> Column:
    """The p-value of a distance under the hypothesis of words, in steps: the larger, the less a run looks like words; -1 if it is not random either."""
    z = (F.lit(WORDS[0]) * F.sqrt(n) - d) / F.lit(WORDS[1])
    # an upper bound of the normal tail, near where it is small
    tail = F.exp(-z * z / 2) / F.lit((2 * math.pi) ** 0.5) * 4 / (3 * z + F.sqrt(z * z + 8))
    p = F.when(z <= 0, 1.0).otherwise(F.least(F.lit(1.0), tail))
    half = d * d / 2  # the tail of four squares
    step = F.least(F.lit(STEPS * POWERS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS)).cast("int")
    return F.when(F.exp(-half) * (half + 1) < RANDOM, -1).otherwise(step)


def _tested(random: Column) -> Column:
    """Candidate runs with their steps and lengths. Functions get a run's own fields only: a captured column would be evaluated for each symbol."""
    place = lambda s: [s[c].alias(c) for c in ("start", "rank", "end")]
    runs = F.transform(random, lambda s: F.struct(*place(s), s["match"].alias("match"), _encoding(s["match"]).alias("k")))
    runs = F.transform(runs, lambda s: F.struct(*place(s), _plain(s["match"], s["k"]).alias("plain"), s["k"].alias("k")))
    runs = F.transform(runs, lambda s: F.struct(*place(s), _numbers(s["plain"], s["k"]).alias("x"), s["k"].alias("k")))
    runs = F.transform(runs, lambda s: F.struct(*place(s), F.struct(*_counts(s["x"], s["k"])).alias("t")))
    runs = F.transform(runs, lambda s: F.struct(*place(s), s["t"]["n"].alias("n"), _distance(s["t"]).alias("d")))
    return F.transform(runs, lambda s: F.struct(*place(s), F.least(s["n"], F.lit(LONGEST)).cast("int").alias("n"), _step(s["d"], s["n"]).alias("step")))


def _weighted(step: Column, n: Column, mean: float) -> Column:
    return F.pow(F.lit(10.0), -step / F.lit(STEPS)) * F.lit(mean) / n


def _threshold(found: DataFrame) -> tuple[float, float]:
    """The mean length of all runs, and the largest weighted p-value that the Benjamini-Hochberg procedure rejects; below 0 if there is none.

    Runs that are not random are among the tested ones: their p-value counts as 1.
    """
    of_run = found.select(F.explode("random").alias("r")).groupBy(F.greatest("r.step", F.lit(0)).alias("step"), F.col("r.n").alias("n")).count()
    total = of_run.agg(F.sum("count"), F.sum(F.col("count") * F.col("n"))).first()
    if not total[0]:
        return 1.0, -1.0
    mean = total[1] / total[0]
    # lengths times steps, at most: one window holds them
    ranked = of_run.withColumn("q", _weighted(F.col("step"), F.col("n"), mean)).withColumn("upto", F.sum("count").over(Window.orderBy("q")))
    last = ranked.where(F.col("q") <= FDR * F.col("upto") / total[0]).agg(F.max("q")).first()[0]
    return mean, -1.0 if last is None else last


def _text(of: Column) -> Column:
    """kind:start:end, by start, then kind as listed, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every whole text.

    Reads doc_id and text. Null text: as an empty one. Null or repeated doc_ids: a row for each row. Texts are read once; their spans and runs are written, and
    one histogram of all runs is shuffled. A text without a match of a pattern is only searched for it. An empty table gives an empty table.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    bare = lambda c: F.coalesce(F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))), none)
    long_value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8
    lettered = lambda s: s["match"].rlike("[A-Za-z]") & ~s["match"].rlike("^[0-9a-f]{32,}$")
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True))
    # a pattern is searched once for matches and, where there are any, once for gaps: columns that are used more than once are not computed again where they are used
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    found = found.select("doc_id", "text", *(spans.matches(F.col("text"), p).alias(f"{kind}_match") for kind, p in patterns.items()))
    gaps = (F.when(F.size(f"{kind}_match") > 0, spans.gaps(F.col("text"), p)).alias(f"{kind}_gap") for kind, p in patterns.items())
    found = found.select("doc_id", *(f"{kind}_match" for kind in KINDS), *gaps)
    found = found.select(
        "doc_id", bare(_found("assign", long_value)).alias("assign"), bare(_found("access")).alias("access"), bare(_found("hex")).alias("hex"),
        _tested(_found("random", lettered)).alias("random"),
    )
    found = written(found, "secrets")
    mean, last = _threshold(found)
    random = F.coalesce(bare(F.filter("random", lambda s: (s["step"] >= 0) & (_weighted(s["step"], s["n"], mean) <= last))), none)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    # in the order of starts, base spans first, a run is covered if one of the base spans before it ends where the run does or later
    every = F.array_sort(F.concat("assign", "access", "hex", random))
    reach = spans.running(F.transform(every, lambda s: F.when(s["rank"] < len(KINDS) - 1, s["end"]).otherwise(0)), F.greatest)
    kept = F.filter(F.arrays_zip(every.alias("s"), reach.alias("reach")), lambda z: (z["s"]["rank"] < len(KINDS) - 1) | (z["reach"] < z["s"]["end"]))
    every = F.transform(kept, lambda z: z["s"])
    return found.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_text(base), 256).alias("base_sha256"), _text(every).alias("spans"), (F.size(every) - F.size("assign") - F.size("access") - F.size("hex")).cast("long").alias("n_random"),
    )
