"""Removal of long repeated byte strings, by bucket-pointer refinement.

Sorting every suffix of a corpus would move each of its bytes many times. Only buckets that
can still split matter, so the refinement is run on those:

1. *Initial buckets.* Of each string of LENGTH bytes the q-gram with the smallest hash is its
   anchor (the leftmost of equal ones): equal strings have equal anchors at equal places,
   and one anchor serves a whole run of strings. Anchors with the same q-gram form a
   bucket; a bucket with one anchor is sorted already and goes, which leaves the
   repeated part of the corpus.
2. *Refinement.* The surroundings of a bucket's anchors meet in one task. Their offsets start
   in buckets of equal 8 bytes; each level splits the buckets by sorting on the bucket
   identifier of a later offset, 8, 16, 32 and then 36 bytes on, so that identifiers stand
   for 16, 32, 64 and 100 bytes; offsets that are alone in their bucket keep their own
   identifier and are sorted no more, and what one level has split, the next one reads at
   later offsets. Identifiers come from the bytes themselves, never from a hash, so two
   strings share a final bucket exactly if their bytes are equal. The first one stays.
3. The runs of later strings are joined to their documents and cut out.

A bucket of more than GROUP anchors (one passage in a third of all documents) is refined by
Spark instead of by one task: equal surroundings are folded with map-side aggregation, and
the rest goes down a tree of places: a row stands for the strings whose anchor is at
places i to j, which have the bytes about the anchor in common; rows are grouped by these
bytes, those alone go, equal ones are folded, and the others are split into smaller spans
of places, down to single strings. So no task holds a large bucket, and what is grouped is always the bytes.

A document whose whole text came before goes whole, so only the first copy of each text is
looked at; copies are found on short rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, in_small_batches, released, sent, whole_text, width
from .minhash import mixed

LENGTH, Q = 100, 32
SPAN = LENGTH - Q + 1  # places of a q-gram in a string
PERIODS = 32  # strings that repeat the one up to so many bytes before need no anchor
#: A bucket is spread while it is counted when HOT_DOCS of about SAMPLE_DOCS documents have it; so at most a bounded number are.
SAMPLE_DOCS, HOT_DOCS = 20_000, 200
#: Larger buckets are refined by Spark, smaller ones each in one task; the result is the same.
GROUP = 4096
#: Spans of places, from level to level, of a large bucket's refinement.
SPANS = (9, 1)
CHUNK, TOGETHER = 1 << 20, 1 << 18  # bytes of text that are looked at, and of surroundings that are refined, at once
_LOW = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)
NONE = -(1 << 63)  # stands for a null id


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of longer strings from those of two shorter ones."""
    with np.errstate(over="ignore"):
        x = (a * _ODD) ^ (b + (a >> np.uint64(32)))
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def qgrams(data: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from each offset on; it deals out anchors and decides on no removal."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    sixteen = _joined(eight[:-8], eight[8:])
    return mixed(_joined(sixteen[:-16], sixteen[16:]))


def smallest(q: np.ndarray) -> np.ndarray:
    """Place of the smallest of each SPAN bucket identifiers in a row, the leftmost of equal ones.

    Places take the low bits of the identifiers; a longer array is cut into overlapping
    blocks whose own places fit.
    """
    found, block = [], int(_LOW) + 2 - SPAN
    for start in range(0, len(q) - SPAN + 1, block):
        own = q[start : start + block + SPAN - 1]
        low = (own & ~_LOW) | np.arange(len(own), dtype=np.uint64)
        reach = 1
        while reach * 2 <= SPAN:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < SPAN:
            low = np.minimum(low[: reach - SPAN], low[SPAN - reach :])
        found.append((low & _LOW).astype(np.int64) + start)
    return np.concatenate(found)


def self_repeats(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """``piece, first, last`` of runs of strings that equal the string up to PERIODS bytes before, in the same piece.

    Such strings go whatever else there is, and none is the first of its kind. In periodic text, which moves
    the anchor with every period, they are all but the first few; left in, they were an anchor each. Where
    LENGTH bytes equal those p before, one of the places that are multiples of 64 begins 32 bytes that
    do, which finds them; other text costs one comparison for 64 bytes and p.
    """
    found, eight = [], np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,)) if len(data) > 7 else np.zeros(0, np.uint64)
    for p in range(1, PERIODS + 1):
        one, two = eight[::64], eight[p::64]
        hits = np.flatnonzero(one[: len(two)] == two) * 64
        hits = hits[hits + 24 + p < len(eight)]
        for more in (8, 16, 24):
            hits = hits[eight[hits + more] == eight[hits + more + p]]
        i = 0
        while i < len(hits):
            low, high = _equal_run(data, int(hits[i]), p)
            i = int(np.searchsorted(hits, high))
            if high - low >= LENGTH:
                for piece in range(int(np.searchsorted(starts, low, side="right")) - 1, int(np.searchsorted(starts, high))):
                    first, last = max(low, int(starts[piece])) + p, min(high + p, int(starts[piece] + sizes[piece])) - LENGTH
                    if first <= last:
                        found.append((piece, first, last))
    return found


def _equal_run(data: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The places around ``at``, from the first to behind the last, whose bytes equal those p on."""
    low, high, step = at, at, 256
    while high + p < len(data):
        other = data[high : high + step][: len(data) - p - high] != data[high + p : high + p + step]
        if other.any():
            high += int(np.argmax(other))
            break
        high, step = high + len(other), step * 4
    step = 256
    while low > 0:
        begin = max(0, low - step)
        other = data[begin:low] != data[begin + p : low + p]
        if other.any():
            low = begin + int(np.flatnonzero(other)[-1]) + 1
            break
        low, step = begin, step * 4
    return low, high


def anchors(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """``piece, bucket, anchor, first, last`` of each run of strings with one anchor; offsets are in the piece."""
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(pieces), np.uint8)
    q = qgrams(data)
    if len(q) < SPAN:
        return (np.zeros(0, np.int64),) * 5
    at = smallest(q)
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
    ends = (starts + sizes)[piece]
    fits = np.arange(len(at)) + LENGTH <= ends
    for _, first, last in self_repeats(data, starts, sizes):
        fits[first : last + 1] = False
    inside = np.flatnonzero(fits)
    if not len(inside):
        return (np.zeros(0, np.int64),) * 5
    at, piece = at[inside], piece[inside]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)])
    end = np.r_[new[1:], len(inside)] - 1
    piece = piece[new]
    return piece, q[at[new]].view(np.int64), at[new] - starts[piece], inside[new] - starts[piece], inside[end] - starts[piece]


def _held(texts, most: int = CHUNK) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Texts as pieces of bytes, some at a time, with the row and the offset of each.

    A long text is cut into pieces that overlap by all but one byte of a string, so each
    string lies whole in exactly one piece.
    """
    places, held, size = [], [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        for start in range(0, max(1, len(data) - LENGTH + 1), most):
            places.append((i, start))
            held.append(data[start : start + most + LENGTH - 1])
            size += len(held[-1])
            if size > most:
                yield places, held
                places, held, size = [], [], 0
    if held:
        yield places, held


def _anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents to their anchors: bucket, document, and a packed place (see :func:`_runs`)."""
    for batch in batches:
        d, v = batch["d"].to_numpy(), batch["v"].to_numpy()
        for places, held in _held(batch["text"]):
            piece, bucket, at, lo, hi = anchors(held)
            row, start = np.array(places, np.int64).T
            yield pd.DataFrame({"bucket": bucket, "d": d[row[piece]], "v": v[row[piece]], "place": lo + start[piece] << 16 | (at - lo) << 8 | (hi - lo)})


def _runs(runs) -> list[tuple[int, int, int, int, bool]]:
    """``first string, bucket, anchor in it, last string, large`` of packed runs, in order and once each."""
    places = sorted({(r["place"] >> 1, r["bucket"], r["place"] & 1) for r in runs})
    return [(p >> 16, bucket, p >> 8 & 255, (p >> 16) + (p & 255), bool(hot)) for p, bucket, hot in places]


def refined(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the LENGTH bytes from each offset on.

    ``left`` is the number of bytes from each offset to the end of its piece; offsets with
    fewer than LENGTH have identifiers of their own.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    _, bucket, size = np.unique(np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64), return_inverse=True, return_counts=True)
    live, length = np.flatnonzero((size[bucket] > 1) & (left >= 8)), 8
    while length < LENGTH:
        step = min(length, LENGTH - length)
        live = live[left[live] >= length + step]
        kinds, own, size = np.unique(bucket[live] * np.int64(2 * n + 1) + bucket[live + step], return_inverse=True, return_counts=True)
        bucket = np.arange(n) + n  # alone, unless split off below
        bucket[live] = own
        live, length = live[size[own] > 1], length + step
    return bucket


def later_strings(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs ``context, first, last`` of strings that an earlier context or an earlier offset has too."""
    sizes = np.array([len(c) for c in contexts])
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - starts[row]
    left = sizes[row] - at
    bucket = refined(np.frombuffer(b"".join(contexts), np.uint8), left)
    whole = np.flatnonzero(left >= LENGTH)
    own = bucket[whole]
    first = np.empty(2 * len(row) + 1, np.int64)
    first[own[::-1]] = whole[::-1]  # of repeated places the last one written stays: the first string
    old = first[own] != whole
    hits = whole[old]
    new = np.flatnonzero(np.r_[True, (row[hits][1:] != row[hits][:-1]) | (hits[1:] != hits[:-1] + 1)]) if len(hits) else np.zeros(0, np.int64)
    stop = np.r_[new[1:], len(hits)] - 1 if len(hits) else new
    return row[hits[new]], at[hits[new]], at[hits[stop]]


def _contexts(large: bool):
    """Documents with their anchors to one row per anchor with the bytes of its run of strings.

    Surroundings that a document had before came earlier in that document; their runs
    are known at once and come (with the other anchors) as rows without bytes, whose
    last string stands in place of the anchor.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for d, v, text, runs in zip(batch["d"], batch["v"], batch["text"], batch["runs"]):
                data, had, again = text.encode("utf-8", "surrogatepass"), set(), []
                for lo, bucket, at, hi, hot in _runs(runs):
                    own = (bucket, at, data[lo : hi + LENGTH])
                    if own not in had:
                        had.add(own)
                        if hot == large:
                            out.append((bucket, d, v, lo, at, own[2]))
                    elif again and again[-1][1] + 1 == lo:
                        again[-1][1] = hi
                    else:
                        again.append([lo, hi])
                if not large:
                    out += [(v, d, v, lo, hi, None) for lo, hi in again]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["bucket", "d", "v", "lo", "at", "bytes"])
                    out = []
            yield pd.DataFrame(out, columns=["bucket", "d", "v", "lo", "at", "bytes"])

    return cut


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of bucket to frames of whole buckets, of about TOGETHER bytes or one bucket each."""
    held, size = None, 0
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        size += int(batch["bytes"].map(len).sum()) if len(batch) else 0
        bucket = held["bucket"].to_numpy()
        if size > TOGETHER and bucket[0] != bucket[-1]:
            cut = int(np.searchsorted(bucket, bucket[-1]))
            yield held[:cut]
            held = held[cut:].reset_index(drop=True)
            size = int(held["bytes"].map(len).sum())
    if held is not None and len(held):
        yield held


def _later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts in order of bucket and place to runs (first, last) of strings that came before.

    Contexts of one place, from rows that repeat id and text, count once.
    """

    def unknown() -> Iterator[pd.DataFrame]:
        for batch in batches:
            none = batch["bytes"].isna()
            if none.any():
                known.append(batch.loc[none, ["d", "v", "lo", "at"]].set_axis(["d", "v", "first", "last"], axis=1))
                batch = batch[~none]
            yield batch

    known: list[pd.DataFrame] = []
    for group in _groups(unknown()):
        yield from known
        known.clear()
        group = group[~group.duplicated(["bucket", "d", "v", "lo"])].reset_index(drop=True)
        own, first, last = later_strings(group["bytes"].tolist())
        lo = group["lo"].to_numpy()[own]
        yield pd.DataFrame({"d": group["d"].to_numpy()[own], "v": group["v"].to_numpy()[own], "first": lo + first, "last": lo + last})
    yield from known


def later_of_large(contexts: DataFrame) -> DataFrame:
    """``d, v, first, last`` of the strings of large buckets that came before; see the module's text."""
    place = F.struct("d", "v", "lo")
    heads = checkpointed(contexts.groupBy("bucket", "at", "bytes").agg(F.min(place).alias("head")))  # so hot keys of the joins are dealt out anew
    after = contexts.join(heads, ["bucket", "at", "bytes"]).where(place > F.col("head"))
    runs = after.select("d", "v", F.col("lo").alias("first"), (F.col("lo") + F.length("bytes") - LENGTH).alias("last"))

    # A row: the strings of a context whose anchor is at places i to j in them; ``anchor`` is its place in ``bytes``.
    rows = heads.select("head.d", "head.v", "head.lo", F.col("at").alias("anchor"), "bytes", F.lit(0).alias("i"), F.lit(SPAN - 1).alias("j"))
    for span in SPANS:
        rows = rows.select("d", "v", "lo", "anchor", "bytes", "j", F.explode(F.sequence(F.col("i"), F.col("j"), F.lit(span))).alias("i"))
        rows = rows.withColumn("j", F.least(F.col("i") + span - 1, F.col("j")))
        # Strings begin i to j bytes before the anchor; the context may have only some of them, or none.
        rows = rows.where(f"anchor - i >= 0 and anchor - j <= length(bytes) - {LENGTH}")
        if span > 1:  # rows alone with the bytes that their strings have in common go
            rows = rows.withColumn("common", F.expr(f"substring(bytes, anchor - i + 1, {LENGTH} - (j - i))"))
            groups = rows.groupBy("i", "common").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "common")
            rows = rows.join(checkpointed(groups), ["i", "common"], "left_semi").drop("common")
        # What is left of the context: the bytes of these strings alone. Equal ones are folded.
        start = F.greatest(F.expr("anchor - j"), F.lit(0))
        own = F.substring("bytes", start + 1, F.least(F.col("anchor") - F.col("i") + LENGTH, F.length("bytes")) - start)
        rows = rows.select("d", "v", (F.col("lo") + start).cast("int").alias("lo"), (F.col("anchor") - start).alias("anchor"), own.alias("bytes"), "i", "j")
        heads = rows.groupBy("i", "j", "anchor", "bytes").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n"))
        heads = checkpointed(heads)
        again = rows.join(heads.where("n > 1").drop("n"), ["i", "j", "anchor", "bytes"]).where(place > F.col("head"))
        runs = runs.unionByName(again.select("d", "v", F.col("lo").alias("first"), (F.col("lo") + F.length("bytes") - LENGTH).alias("last")))
        rows = heads.select("head.d", "head.v", "head.lo", "anchor", "bytes", "i", "j")
    return runs


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with their runs of later strings to what is left of them."""
    for batch in batches:
        out, texts = [], [text.encode("utf-8", "surrogatepass") for text in batch["text"]]
        sizes = np.array([len(x) for x in texts], np.int64)
        starts, own = np.cumsum(sizes) - sizes, defaultdict(list)
        for i, first, last in self_repeats(np.frombuffer(b"".join(texts), np.uint8), starts, sizes):
            own[i].append((first - int(starts[i]), last - int(starts[i]) + LENGTH))
        for i, (doc_id, data, copy, runs) in enumerate(zip(batch["doc_id"], texts, batch["copy"], batch["runs"])):
            spans: list[list[int]] = [[0, len(data)]] if copy and len(data) >= LENGTH else []
            later = own[i] + [(r["first"], r["last"] + LENGTH) for r in (runs if runs is not None else [])]
            for lo, hi in sorted([] if copy else later):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            left, at = hashlib.sha256(), 0
            for lo, hi in [*spans, [len(data), len(data)]]:
                left.update(data[at:lo])
                at = hi
            out.append((doc_id, len(data), sum(hi - lo for lo, hi in spans), len(spans), left.hexdigest(), ",".join(f"{lo}:{hi}" for lo, hi in spans)))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]).astype({"doc_id": "Int64"})


_ANCHOR = "bucket long, d long, v long, place long"
_CONTEXT = "bucket long, d long, v long, lo int, at int, bytes binary"


def frequent_buckets(texts: DataFrame) -> list[int]:
    """Buckets that HOT_DOCS or more of about SAMPLE_DOCS documents have; the sample only decides on routes."""
    every = max(1, texts.count() // SAMPLE_DOCS)
    sample = texts.where(F.pmod(F.xxhash64("d", "v"), F.lit(every)) == 0)
    common = sample.mapInPandas(_anchored, _ANCHOR).groupBy("bucket").agg(F.count_distinct("d", "v").alias("n")).where(F.col("n") >= HOT_DOCS)
    return [r["bucket"] for r in common.select("bucket").collect()]


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of each row.

    Every byte that a string of LENGTH bytes covers goes if the string also starts
    earlier: in a document with a smaller id (null first, equal ids by a hash of the
    text; rows that repeat id and text are one and the same), or before in its own.
    Null is empty; texts below LENGTH bytes stay whole, very long ones are worked on in
    overlapping pieces; an empty table gives an empty result; other columns are not
    looked at. ``spans`` are the removed byte ranges.
    """
    texts = in_small_batches(docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NONE)).alias("d"), whole_text(text_column).alias("text")))
    texts = texts.select("d", F.xxhash64("text").alias("v"), "text")
    place = F.struct("d", "v")
    short = texts.select("d", "v", F.md5(F.col("text").cast("binary")).alias("h"))
    firsts = checkpointed(short.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    copies = checkpointed(short.join(sent(firsts), "h").where(place > F.col("first")).select("d", "v").distinct())  # of texts that came before
    frequent = texts.sparkSession.createDataFrame([(b, True) for b in frequent_buckets(texts)], "bucket long, hot boolean")

    anchored = texts.join(sent(copies), ["d", "v"], "left_anti").mapInPandas(_anchored, _ANCHOR).join(F.broadcast(frequent), "bucket", "left")
    own = F.when(F.col("hot"), F.xxhash64("bucket", "d", "v")).otherwise(F.col("bucket"))  # frequent ones need no count
    counted = anchored.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(own)))
    large = (F.coalesce("hot", F.lit(False)) | (F.col("n") > GROUP)).cast("long")
    repeated = counted.where("n > 1 or hot").groupBy("d", "v").agg(F.collect_list(F.struct("bucket", (F.col("place") * 2 + large).alias("place"))).alias("runs"))  # a document's own runs
    repeated = released(checkpointed(repeated))  # short rows that both routes read

    def having(runs: DataFrame) -> DataFrame:
        return texts.select("d", "v", "text").join(runs, ["d", "v"])

    contexts = having(repeated).mapInPandas(_contexts(False), _CONTEXT)
    runs = contexts.repartition(width(texts), "bucket").sortWithinPartitions("bucket", "d", "v", "lo").mapInPandas(_later, "d long, v long, first int, last int")
    of_large = having(repeated.where(F.exists("runs", lambda r: r["place"] % 2 == 1))).mapInPandas(_contexts(True), _CONTEXT)
    runs = released(runs.unionByName(later_of_large(of_large)))
    runs = runs.groupBy("d", "v").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # a document's own runs
    whole = texts.select("d", "v", "text").join(runs, ["d", "v"], "left")  # reads the exchange of texts that the contexts are cut from
    whole = whole.join(sent(copies).withColumn("copy", F.lit(True)), ["d", "v"], "left")
    whole = whole.select(F.when(F.col("d") != NONE, F.col("d")).alias("doc_id"), "text", F.coalesce("copy", F.lit(False)).alias("copy"), "runs")
    return whole.mapInPandas(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")
