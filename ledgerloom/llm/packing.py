"""Packing token sequences by minimum bin slack.

A document's ids are cut into full windows and one remainder. Remainders are packed by
their *lengths*: a histogram (at most window - 1 entries, whatever the corpus size) goes to
the driver, where a bitset subset-sum programme picks, for the longest length that is left,
the multiset of lengths that fills its window closest to capacity; the pattern is repeated
as often as the counts allow. If the best pattern leaves a gap, one further piece is cut to
close it. The plan is a bounded table of rank intervals; Spark ranks the documents of each
length and joins them to it.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, in_small_batches, sent, whole_text, width

WINDOW, END_ID = 2048, 1
#: Ranks are counted in so many parts of a length, each by itself, and in more when a part would have more than PART_ROWS.
PARTS, PART_ROWS = 4096, 1_000_000


def _encoder(name: str):
    """Encoder for one of the public vocabularies, loaded once a process.

    ``tiktoken`` and ``tokenizers`` give the same ids for the two files of this
    vocabulary (tests hold them together); the former is four times as fast. The
    added tokens, which ``tokenizers`` finds in text, stand in the JSON file alone.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        with open(public_tokenizers.path(name.replace(".tiktoken", ".json")), encoding="utf-8") as file:
            added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
        _encoders[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _encoders[name]


_encoders: dict = {}


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """All ids of a text and the end id, as little-endian unsigned 32-bit numbers."""
    ids = _encoder(vocabulary).encode(text, allowed_special="all")
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths whose sum comes closest to ``capacity`` from below.

    Subset-sum over bitsets: bit s is set when s can be reached; counts are split into
    powers of two; the kept bitsets are walked backwards for the numbers used.
    """
    reach, full, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x in counts if 0 < x <= capacity and counts[x] > 0), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0:
            n = min(take, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & full
            left, take = left - n, take * 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            used[length] += n
            total -= length * n
    return dict(used)


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple], int]:
    """Rows ``(length, first, last, start, n, sequence, offset)`` and the number of sequences.

    The item of rank r (first <= r < last) among the remainders of ``length`` has its ids
    ``start`` to ``start + n`` in sequence ``sequence + r - first`` at ``offset``. Every
    sequence is full but those of the last ids, fewer than a window, which are cut into
    lengths that are powers of two.
    """
    count: dict[int, int] = defaultdict(int)
    queue: dict[int, deque] = defaultdict(deque)
    for length, n in sorted(histogram.items()):
        if n > 0:
            count[length] = n
            queue[length].append((length, 0, n, 0))  # remainder length, ranks from and to, start of this piece
    rows, sequence, total = [], 0, sum(length * n for length, n in histogram.items())

    def place(length: int, reps: int, base: int, offset: int, part: int) -> None:
        """Take ``reps`` pieces of a length; ``part`` ids of each go to the sequences from ``base`` on."""
        done = 0
        while done < reps:
            origin, first, last, start = queue[length].popleft()
            n = min(reps - done, last - first)
            rows.append((origin, first, first + n, start, part, base + done, offset))
            if part < length:
                queue[length - part].append((origin, first, first + n, start + part))
                count[length - part] += n
            if first + n < last:
                queue[length].appendleft((origin, first + n, last, start))
            done += n
        count[length] -= reps
        if not count[length]:
            del count[length]

    while total >= window:
        longest = max(count)
        count[longest] -= 1
        pattern = closest_fill(count, window - longest)
        count[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        gap = window - sum(length * n for length, n in pattern.items())
        need, cut = dict(pattern), None
        if gap:
            cut = max(length for length, n in count.items() if n > pattern.get(length, 0))
            need[cut] = need.get(cut, 0) + 1
        reps = min(count[length] // n for length, n in need.items())
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            for _ in range(n):
                place(length, reps, sequence, offset, length)
                offset += length
        if cut is not None:
            place(cut, reps, sequence, offset, gap)
        sequence, total = sequence + reps, total - reps * window
    space = offset = 0
    while count:
        if not space:
            space, offset = 1 << (total.bit_length() - 1), 0
        length = max(count)
        part = min(length, space)
        place(length, 1, sequence, offset, part)
        offset, space, total = offset + part, space - part, total - part
        sequence += not space
    return rows, sequence


def _measured(vocabulary: str, window: int):
    """Batches of documents to their numbers of ids and the checksum of each window of ids."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers, sums = [], []
            for text in batch["text"]:
                ids = token_ids(text, vocabulary)
                numbers.append(len(ids))
                sums.append([zlib.crc32(ids[a : a + window]) for a in range(0, len(ids), window)])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "v": batch["v"], "doc_tokens": numbers, "sums": sums})

    return measure


def _cut_sums(vocabulary: str):
    """Batches of documents with the cuts of their remainders to the checksum of each cut."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                ids = token_ids(row.text, vocabulary)
                out += [(None if pd.isna(row.doc_id) else int(row.doc_id), row.v, int(c["start"]), int(c["length"]), zlib.crc32(ids[c["start"] : c["start"] + c["length"]])) for c in row.cuts]
            yield pd.DataFrame(out, columns=["cut_id", "cut_v", "start", "length", "ids_crc32"]).astype({"cut_id": "Int64"})

    return measure


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every row of ``docs`` is packed, repeated ids and rows and rows without id too; null
    text is empty and has the end id alone; long texts take as many windows as they need. Sequences below the number of packed windows hold remainders, those
    above one full window each. No two pieces of a sequence overlap and none is cut
    but to close a gap. An empty table gives an empty result; only ``doc_id`` and
    ``text`` are read, whatever other columns are called.

    The ids are not kept: checksums of windows and remainders are taken as the text is
    encoded, and only documents whose remainder is cut are encoded once more.
    """
    texts = in_small_batches(docs.select("doc_id", F.xxhash64(whole_text()).alias("v"), whole_text().alias("text")))
    measured = checkpointed(texts.mapInPandas(_measured(vocabulary, WINDOW), "doc_id long, v long, doc_tokens long, sums array<long>"))
    parts = max(PARTS, measured.count() // PART_ROWS)
    rows = measured.select(
        "doc_id",
        "v",
        "doc_tokens",
        "sums",
        (F.col("doc_tokens") % WINDOW).cast("int").alias("rest"),
        F.expr(f"doc_tokens div {WINDOW}").alias("full"),
        F.when(F.col("doc_tokens") % WINDOW > 0, F.element_at("sums", -1)).otherwise(F.lit(0).cast("long")).alias("tail"),
        F.pmod(F.xxhash64("doc_id", "v", F.when(F.col("doc_id").isNull(), F.spark_partition_id())), F.lit(parts)).cast("int").alias("part"),  # rows without id are spread, too
    )
    histogram = {r["rest"]: r["count"] for r in rows.where("rest > 0").groupBy("rest").count().collect()}  # at most WINDOW - 1 rows
    plan, packed = plan_windows(histogram)
    intervals = docs.sparkSession.createDataFrame(plan or [(0, 0, 0, 0, 0, 0, 0)], "rest int, first long, last long, cut_start int, cut_length int, base long, offset long")

    # Ranks: the parts are counted, the counts are summed up along the parts, and each part ranks its own rows.
    by_part = rows.repartition(width(docs), "part")
    order = ["doc_id", "doc_tokens", "v"]
    ranked = by_part.select(
        "*",
        (F.row_number().over(Window.partitionBy("part", "rest").orderBy(*order)) - 1).cast("long").alias("rank"),
        F.coalesce(F.sum("full").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("fulls"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full"))
    ranks = sizes.select("part", "rest", F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank0"))
    fulls = sizes.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full0"))  # one row a part
    ranked = ranked.join(ranks, ["part", "rest"]).join(fulls, "part")

    whole = ranked.where("full > 0").select("doc_id", "doc_tokens", F.posexplode(F.slice("sums", F.lit(1), F.col("full").cast("int"))).alias("i", "ids_crc32"), (F.col("fulls") + F.col("full0") + packed).alias("base"))
    whole = whole.select("doc_id", (F.col("i").cast("long") * WINDOW).alias("start"), F.lit(WINDOW).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("base") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    at = F.col("rank") + F.col("rank0")
    rest = ranked.where("rest > 0").select("doc_id", "v", "doc_tokens", "tail", "rest", "full", at.alias("at"))
    rest = rest.join(sent(intervals, len(plan)), "rest").where("at >= first and at < last")
    rest = rest.select(
        "doc_id",
        "v",
        (F.col("full") * WINDOW + F.col("cut_start")).alias("start"),
        F.col("cut_length").cast("long").alias("length"),
        "tail",
        (F.col("cut_length") < F.col("rest")).alias("cut"),
        "doc_tokens",
        (F.col("base") + F.col("at") - F.col("first")).alias("sequence_id"),
        "offset",
    )
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    uncut = rest.where("not cut").withColumn("ids_crc32", F.col("tail")).select(*out)
    if not any(n < length for length, _, _, _, n, _, _ in plan):
        return whole.unionByName(uncut)

    cut = rest.where("cut")
    jobs = cut.select("doc_id", "v", "start", "length").distinct()
    cuts = jobs.groupBy(F.col("doc_id").alias("cut_id"), F.col("v").alias("cut_v")).agg(F.collect_list(F.struct("start", "length")).alias("cuts"))  # a text's own cuts
    cuts = sent(cuts, sum(last - first for length, first, last, _, n, _, _ in plan if n < length))  # so many ids and cuts at most
    one = F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("v") == F.col("cut_v"))  # an id may be null, or have several texts
    again = texts.join(cuts, one).select("doc_id", "v", "text", "cuts").mapInPandas(_cut_sums(vocabulary), "cut_id long, cut_v long, start long, length long, ids_crc32 long")
    again = again.dropDuplicates(["cut_id", "cut_v", "start", "length"])
    same = one & (cut["start"] == again["start"]) & (cut["length"] == again["length"])
    return whole.unionByName(uncut).unionByName(cut.join(again, same).select(*[again[c] if c == "ids_crc32" else cut[c] for c in out]))
