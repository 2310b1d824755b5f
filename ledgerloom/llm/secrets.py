"""Secret scans, on DataFrame functions alone.

Base rules find assignments, access keys and long hex strings. The method adds long mixed
strings that look random: a battery of three tests (chi-squared for a uniform alphabet,
runs about the alphabet's middle, serial correlation) under the encoding that the
string's characters suggest gives one statistic of randomness.

What it gives for *ordinary* strings, text written in the same encoding, is tabulated by
length band and encoding from a fixed set of simulated ones, letters drawn as often as
text has them. The share of those that look at least as random as a string is its p-value
for being ordinary, and Benjamini and Hochberg's rule, in each length band by itself (long
strings have power that short ones lack) and with Storey's estimate of the number of
ordinary ones, declares the strings that are not: of those that are *reported*, at most a
share of LEVEL are ordinary strings. Strings of digits alone are numbers and not tested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, whole_text

ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the maximal runs of 32 and more
KINDS = ("assign", "access", "hex", "random")
LEAST_LENGTH = 20
STRING = rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}"
#: Length bands by their shortest strings; a string is in the last one that it reaches.
LEVEL, BANDS = 0.1, (LEAST_LENGTH, 24, 28, 32, 40, 48, 64, 96, 128, 256, 512)
NULL_CHARACTERS, NULL_LENGTH = 32_000, 128  # simulated for each band and encoding; longer bands share the strings of NULL_LENGTH
ORDER_WEIGHT = 0.25
BINS = 120  # the statistic is counted by tenths
_ALPHABETS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="
_SPAN = "array<struct<start:int,stop:int,text:string>>"


#: A running total is taken over parts of so many entries, whose totals are summed in the same way, so many levels deep.
PART, LEVELS = 256, 2


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def running(numbers: Column, zero: Column, both: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each entry of an array, ``both`` folded from the first entry to it.

    An array that grows by an entry is copied, so a fold over a long one takes the square of its length; here
    only arrays of PART entries grow, and the one of the parts' totals: ten million matches in one text have 40,000.
    """

    def short(part: Column, first: Column) -> Column:
        whole = F.aggregate(part, F.array(first), lambda found, x: F.concat(found, F.array(both(F.element_at(found, -1), x))))
        return F.slice(whole, 2, F.size(part))

    if levels == 1:
        return _let(numbers, lambda whole: short(whole, zero))

    def joined(parts: Column) -> Column:
        totals = running(F.transform(parts, lambda p: F.aggregate(p, zero, both)), zero, both, levels - 1)
        return _let(totals, lambda t: F.flatten(F.transform(parts, lambda p, i: short(p, F.coalesce(F.get(t, i - 1), zero)))))

    def cut(whole: Column) -> Column:
        last = F.floor(F.greatest(F.size(whole) - 1, F.lit(0)) / PART).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(whole, i * PART + 1, PART))

    return _let(_let(numbers, cut), joined)


def spans(text: str, pattern: str) -> Column:
    """All matches of a pattern, leftmost first and not overlapping, as (start, stop, text).

    Splitting at the pattern gives what lies between the matches, so running totals of
    lengths give the places, in code points.
    """
    column, zero = F.col(text), F.lit(0)

    def placed(x: Column) -> Column:
        ends = running(F.transform(x["hits"], lambda hit, i: F.length(F.get(x["gaps"], i)) + F.length(hit)), zero, lambda a, b: a + b)
        return _let(ends, lambda e: F.transform(x["hits"], lambda hit, i: F.struct((F.get(e, i) - F.length(hit)).alias("start"), F.get(e, i).alias("stop"), hit.alias("text"))))

    found = _let(F.struct(F.split(column, pattern, -1).alias("gaps"), F.regexp_extract_all(column, F.lit(pattern), F.lit(0)).alias("hits")), placed)
    return F.when(column.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _clear(strings: Column, base: Column) -> Column:
    """The strings that overlap none of the base spans, by places.

    Both are put in order by where they start. A string is overlapped if a base span before it ends
    behind its start, or the next one starts before its end.
    """
    most, none = F.lit(2**31 - 1), F.lit(-1)
    entry = lambda x, kind: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop"))
    order = F.array_sort(F.concat(F.transform(base, lambda b: entry(b, 0)), F.transform(strings, lambda s: entry(s, 1))))

    def kept(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: F.when(r["kind"] == 0, r["stop"]).otherwise(none)), none, lambda a, b: F.greatest(a, b))
        starts = running(F.transform(F.reverse(rows), lambda r: F.when(r["kind"] == 0, r["start"]).otherwise(most)), most, lambda a, b: F.least(a, b))
        both = F.struct(ends.alias("ends"), F.reverse(starts).alias("starts"))
        free = lambda x: F.filter(F.transform(rows, lambda r, i: F.when((r["kind"] == 1) & (F.get(x["ends"], i) <= r["start"]) & (F.get(x["starts"], i) >= r["stop"]), F.struct(r["start"].alias("start"), r["stop"].alias("stop")))), lambda r: r.isNotNull())
        return _let(both, free)

    return F.when(F.size(strings) > 0, _let(order, kept)).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))


def _normal(z: str) -> str:
    """Distribution function of the normal distribution, to about 0.0002."""
    return f"(1D / (1D + exp(-least(40D, greatest(-40D, 1.5976D * ({z}) + 0.07056D * pow({z}, 3))))))"


def _two_sided(z: str) -> str:
    return f"greatest(1e-12D, 2D * {_normal(f'-abs({z})')})"


def _battery(token: str, k: str, order: str) -> str:
    """Statistic of one string against "uniform over k characters, independent": 0 or more, small for random ones.

    The decimal logarithms of the three p-values are added; those of the two tests that
    go along the string weigh less, as ordinary text differs from random strings by its
    alphabet most of all, and repeated patterns by their order beyond all measure.

    x.c are the characters' places in the alphabet. Chi-squared needs the squared counts
    alone, which the sorted places give; runs and correlation go along the string.
    """
    chi = "((x.k * x.squares / x.n - x.n) - (x.k - 1)) / sqrt(2D * (x.k - 1) * (1D - 1D / x.n))"
    runs = "(y.runs - (2D * y.up * y.down / y.n + 1)) / sqrt(greatest(1e-9D, 2D * y.up * y.down * (2D * y.up * y.down - y.n) / (1D * y.n * y.n * greatest(1, y.n - 1))))"
    serial = "(coalesce(try_divide(y.lagged, y.spread), 1D) + 1D / y.n) * sqrt(1D * y.n)"
    return f"""
      transform(transform(transform(array(struct(
          cast(length({token}) AS double) AS n, {k} AS k,
          transform(filter(split({token}, ''), ch -> ch <> ''), ch -> cast(instr({order}, ch) AS double)) AS c,
          aggregate(array_distinct(split({token}, '')), 0D, (s, ch) -> s + CASE WHEN ch = '' THEN 0D ELSE pow(length({token}) - length(replace({token}, ch, '')), 2) END) AS squares)),
        x -> struct(x.n AS n, x.c AS c, {chi} AS chi, aggregate(x.c, 0D, (s, v) -> s + v) / x.n AS mean, array_sort(x.c)[cast(x.n AS int) div 2] AS middle)),
        x -> struct(x.n AS n, x.chi AS chi,
          cast(size(filter(x.c, v -> v >= x.middle)) AS double) AS up, cast(size(filter(x.c, v -> v < x.middle)) AS double) AS down,
          aggregate(sequence(1, size(x.c) - 1), 1D, (s, i) -> s + CASE WHEN (x.c[i] >= x.middle) <> (x.c[i - 1] >= x.middle) THEN 1D ELSE 0D END) AS runs,
          aggregate(sequence(1, size(x.c) - 1), 0D, (s, i) -> s + (x.c[i] - x.mean) * (x.c[i - 1] - x.mean)) AS lagged,
          aggregate(x.c, 0D, (s, v) -> s + pow(v - x.mean, 2)) AS spread)),
        y -> -log10(greatest(1e-12D, {_normal("-(y.chi)")})) - {ORDER_WEIGHT}D * (log10({_two_sided(runs)}) + log10({_two_sided(serial)})))[0]"""


#: Encodings in the order in which they are tried: (pattern, string to be tested, alphabet size, its order).
_ORDER = f"'{_ALPHABETS}'"
_ENCODINGS = (
    (r"^([0-9a-f]+|[0-9A-F]+)$", "lower(t.text)", 16, _ORDER),
    (r"^[A-Za-z]?([a-z]+|[A-Z]+)$", "lower(t.text)", 26, "'abcdefghijklmnopqrstuvwxyz'"),
    (r"^[A-Z2-7]+=*$", "t.text", 32, "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567='"),
    (r"^[A-Za-z0-9]+$", "t.text", 62, _ORDER),
    (r"", "t.text", 65, _ORDER),
)


#: How often the letters a to z occur in a thousand letters of English text, at least once.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
_URN = "".join(chr(97 + i) * n for i, n in enumerate(LETTERS))
#: Shares in percent of capitals, digits and marks in ordinary strings of the larger alphabets.
CAPITALS, DIGITS, MARKS = 10, 5, 5


def _encoding() -> str:
    """Place of a string's encoding in _ENCODINGS."""
    return "CASE " + " ".join(f"WHEN t.text RLIKE r'{p}' THEN {i}" for i, (p, *_) in enumerate(_ENCODINGS)) + " END"


def _scored(strings: str, encoding: str = _encoding()) -> Column:
    """Strings to (start, stop, band, encoding, bin of the statistic)."""
    case = lambda at: "CASE t.encoding " + " ".join(f"WHEN {i} THEN {e[at]}" + "D" * (at == 2) for i, e in enumerate(_ENCODINGS)) + " END"
    return F.expr(f"""
      transform(transform(transform({strings}, t -> struct(t.start AS start, t.stop AS stop, t.text AS text, {encoding} AS encoding)),
        t -> struct(t.start AS start, t.stop AS stop, t.encoding AS encoding, {case(1)} AS tested, {case(2)} AS k, {case(3)} AS alphabet)),
        t -> struct(t.start AS start, t.stop AS stop, array_max(filter(array({", ".join(map(str, BANDS))}), b -> b <= t.stop - t.start)) AS band, t.encoding AS encoding,
          cast(least({BINS}D, floor(10 * {_battery("t.tested", "t.k", "t.alphabet")})) AS int) AS bin))""")


def ordinary(spark: SparkSession) -> dict[tuple[int, int], dict[int, int]]:
    """Number of simulated ordinary strings by (band, encoding) and bin; the same in every run and on every corpus.

    Text in hexadecimal is the code of its characters, in capitals and digits its capital
    letters and some digits, in the larger alphabets the text with some capitals, digits
    and marks. A band is represented by its shortest strings, which are the hardest.
    """
    if not _ordinary:
        letter, kind = f"substr('{_URN}', 1 + cast(pmod(h, {len(_URN)}) AS int), 1)", "pmod(shiftright(h, 20), 100)"
        digit = lambda digits: f"substr('{digits}', 1 + cast(pmod(h, {len(digits)}) AS int), 1)"
        capital = f"WHEN {kind} < {DIGITS + CAPITALS} THEN upper({letter}) ELSE {letter} END"
        number = f"CASE WHEN {kind} < {DIGITS} THEN {digit('0123456789')}"
        mark = f"WHEN {kind} >= {100 - MARKS} THEN {digit('+/_-')}"
        drawn = f"CASE i WHEN 2 THEN CASE WHEN {kind} < {DIGITS} THEN {digit('234567')} ELSE upper({letter}) END WHEN 3 THEN {number} {capital} WHEN 4 THEN {number} {mark} {capital} ELSE {letter} END"
        shortest = [b for b in BANDS if b <= NULL_LENGTH]
        rows = spark.createDataFrame([(n, i) for n in shortest for i in range(len(_ENCODINGS))], "n int, i int").repartition(spark.sparkContext.defaultParallelism, "n", "i")
        rows = rows.select("n", "i", F.explode(F.expr(f"sequence(1, {NULL_CHARACTERS} div n)")).alias("id"))
        rows = rows.withColumn("text", F.expr(f"array_join(transform(transform(sequence(1, CASE i WHEN 0 THEN n div 2 ELSE n END), at -> xxhash64(id, at, n, i)), h -> {drawn}), '')"))
        rows = rows.select("i", F.expr("array(struct(0 AS start, n AS stop, CASE i WHEN 0 THEN lower(hex(text)) ELSE text END AS text))").alias("strings"))
        for r in rows.select(F.explode(_scored("strings", "i")).alias("x")).groupBy("x.band", "x.encoding", "x.bin").count().collect():
            for band in BANDS:
                if min(band, shortest[-1]) == r["band"]:
                    _ordinary.setdefault((band, r["encoding"]), {})[r["bin"]] = r["count"]
    return _ordinary


_ordinary: dict[tuple[int, int], dict[int, int]] = {}


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Base spans of each kind and the tested strings of each row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("_text"))
    rows = rows.select(
        "doc_id",
        spans("_text", ASSIGN).alias("assign"),
        F.expr(rf"CASE WHEN _text RLIKE r'{ASSIGN}' THEN regexp_extract_all(_text, r'{ASSIGN}', 2) ELSE cast(array() AS array<string>) END").alias("values"),
        spans("_text", ACCESS).alias("access"),
        spans("_text", HEX).alias("hex"),
        F.filter(spans("_text", STRING), lambda x: ~x["text"].rlike("^[0-9]+$")).alias("strings"),
    )
    place = "x -> struct(x.start AS start, x.stop AS stop)"
    return rows.select(
        "doc_id",
        F.expr(f"transform(filter(zip_with(assign, values, (x, v) -> struct(x.start AS start, x.stop AS stop, length(v) AS n)), x -> x.n >= 8), {place})").alias("assign"),
        F.expr(f"transform(filter(access, x -> x.stop - x.start >= 16), {place})").alias("access"),
        F.expr(f"transform(hex, {place})").alias("hex"),
        _scored("strings").alias("strings"),
    )


def thresholds(found: DataFrame, level: float = LEVEL) -> dict[tuple[int, int], int]:
    """(band, encoding) to the last bin whose strings are reported, for those that have one.

    The histogram of all tested strings has at most bands times encodings times bins
    rows, whatever the corpus size.
    """
    counts = found.select(F.explode("strings").alias("x")).groupBy("x.band", "x.encoding", "x.bin").count().collect()
    null, last = ordinary(found.sparkSession), {}
    for band in BANDS:
        cells = []
        for r in counts:
            if r["band"] == band:
                own = null[band, r["encoding"]]
                cells.append(((1 + sum(n for b, n in own.items() if b <= r["bin"])) / (1 + sum(own.values())), r["encoding"], r["bin"], r["count"]))
        total = sum(n for *_, n in cells)
        of_null = min(total, 2 * (1 + sum(n for p, *_, n in cells if p > 0.5)))
        cut, so_far = 0.0, 0
        for p, _, _, n in sorted(cells):
            so_far += n
            if of_null * p <= level * so_far:
                cut = p
        for p, encoding, b, _ in cells:
            if p <= cut:
                last[band, encoding] = max(b, last.get((band, encoding), 0))
    return last


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", level: float = LEVEL) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` of each row.

    Null and empty texts have no spans; texts of any length are scanned whole; rows that
    repeat are scanned alike; an empty table gives an empty result; other columns are not looked at. Added spans are of kind
    ``random`` and overlap no base span.
    """
    found = checkpointed(features(docs, id_column, text_column))
    passes = " OR ".join(f"(x.band = {band} AND x.encoding = {e} AND x.bin <= {b})" for (band, e), b in thresholds(found, level).items()) or "false"
    rows = found.withColumn("random", F.expr(f"filter(strings, x -> {passes})"))
    rows = rows.withColumn("random", _clear(F.col("random"), F.concat(*KINDS[:3])))
    row = lambda kind: f"transform({kind}, x -> struct(x.start AS start, {KINDS.index(kind)} AS rank, concat('{kind}:', x.start, ':', x.stop) AS span))"
    joined = lambda *kinds: F.expr(f"array_join(transform(array_sort(concat({', '.join(map(row, kinds))})), x -> x.span), ',')")
    return rows.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(joined(*KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        joined(*KINDS).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
