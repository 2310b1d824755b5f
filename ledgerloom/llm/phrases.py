"""Phrase collocation mining with vertical positional inverted lists.

Documents are dealt into blocks of bounded bytes. In a block every word has the list of the
positions at which it occurs, and so has every frequent phrase; positions are numbered so
that no two words of different pieces are neighbours. Phrases grow word by word: the list
of a frequent phrase of k words is merge-joined, k positions on, with the postings of the frequent
words, which gives the lists of all phrases of k + 1 words that begin with it. The length of a list
is its block's exact count, and Spark adds the counts of all blocks.

Most phrases of a block are rare everywhere, and a row for each would be the bulk of all that is
shuffled. So blocks first send packets: the hashes of their phrases in order, with counts, packed.
Where a hash is summed up to less than the least count, its phrases are rare, and no block
looks at them again; a phrase is never lost, as whatever shares its hash only adds. What is left
is counted by its words. Lists never leave their block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, in_small_batches, new_folder, remove_folder, sent, whole_text, width

#: Bytes of text of a block (a piece of a text that is longer is a block of its own), and the longest phrase.
BLOCK_BYTES, LONGEST = 16 << 20, 5
LEAST_COUNT, ABSORBED_PERCENT, SHOWN = 100, 100, 2000
NO_LANG = "und"
#: Classes of bytes: what ends a piece, what parts words, and all others; capital letters become small.
_SEPARATOR, _BLANK, _WORD = range(3)
_CLASSES = np.full(256, _WORD, np.uint8)
_CLASSES[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _SEPARATOR
_CLASSES[[0x20, 0x09]] = _BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bits of a word's hash; those of phrases are chosen by :func:`hash_bits`. What shares a hash is only counted for nothing.
WORD_BITS, SPARE_BITS = 36, 5
#: Rows of a block: packets of hashes or of phrases (with ``part``), words of a language (with ``n``), and one row with what is left of the block.
_ROWS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("said", pa.binary()), ("lengths", pa.binary()), ("lang", pa.string()), ("n", pa.int64()), ("gaps", pa.binary()), ("who", pa.binary()), ("begins", pa.binary()), ("words", pa.binary())])
_SCHEMA = "block long, part int, hashes binary, counts binary, said binary, lengths binary, lang string, n long, gaps binary, who binary, begins binary, words binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 0 or more, byte by byte, compressed; small ones take a byte or less."""
    size = 8 if len(numbers) and numbers.max() >= 2**32 else 4 if len(numbers) and numbers.max() >= 256 else 1
    planes = np.ascontiguousarray(numbers.astype(f"u{size}").view(np.uint8).reshape(len(numbers), size).T)
    return np.array([len(numbers), size], np.int64).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n, size = (int(x) for x in np.frombuffer(data[:16], np.int64))
    planes = np.frombuffer(pa.decompress(data[16:], size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"u{size}").ravel().astype(np.int64)


def _packed_texts(texts: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("t", pa.string())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([texts], names=["t"]))
    return out.getvalue().to_pybytes()


def _unpacked_texts(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column("t").combine_chunks()


def hash_bits(words: int, least: int) -> int:
    """Bits enough for ``words`` words: at most words / ``least`` phrases of a length are frequent, and a rare one is taken for such with a chance of 1 / 32 or less."""
    return max(16, min(60, math.ceil(math.log2(max(words, 1) / least + 1)) + SPARE_BITS))


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=0)


def _batch(size: int, **columns) -> pa.RecordBatch:
    """``size`` rows of a block; columns that are not named are null."""
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _ROWS], schema=_ROWS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, which has its language behind a line feed."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _longer_hashes(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases with one more word."""
    return _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + word)


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _in_parts(hashes: np.ndarray, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by hash, the places in it at which ranges of hashes begin, and the ranges that have any."""
    order = np.argsort(hashes)
    ends = np.searchsorted(hashes[order], [(i << bits) // parts for i in range(parts + 1)])
    return order, ends, np.flatnonzero(np.diff(ends))


def _packets(block: int, hashes: np.ndarray, counts: np.ndarray, parts: int, bits: int) -> pa.RecordBatch:
    """The hashes of a block's phrases in order, with counts, a packet for each range of hashes that has any."""
    hashes, place = np.unique(_short(hashes, bits), return_inverse=True)
    counts = np.bincount(place, weights=counts, minlength=len(hashes)).astype(np.int64)
    _, ends, held = _in_parts(hashes, parts, bits)
    own = lambda x, f=lambda x: x: pa.array([_packed(f(x[ends[i] : ends[i + 1]])) for i in held], pa.binary())
    return _batch(len(held), block=pa.array(np.full(len(held), block)), part=pa.array(held.astype(np.int32)), hashes=own(hashes, _gaps), counts=own(counts))


def _phrases(block: int, hashes: np.ndarray, said: pa.Array, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """The phrases themselves with their counts, in the same way; those of a packet are in order, which packs well."""
    bounds = [(i << WORD_BITS) // parts for i in range(1, parts)]
    part = np.searchsorted(bounds, _short(hashes, WORD_BITS), side="right")
    order = np.asarray(pc.sort_indices(said)).astype(np.int64)
    order = order[np.argsort(part[order], kind="stable")]
    ends, texts, counts = np.searchsorted(part[order], np.arange(parts + 1)), said.take(pa.array(order)), counts[order]
    held = np.flatnonzero(np.diff(ends))
    places = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    own = lambda x: pa.array([_packed(x[ends[i] : ends[i + 1]]) for i in held], pa.binary())
    data = [_packed(np.frombuffer(texts.buffers()[2], np.uint8)[places[ends[i]] : places[ends[i + 1]]]) for i in held]
    return _batch(len(held), block=pa.array(np.full(len(held), block)), part=pa.array(held.astype(np.int32)), counts=own(counts), said=pa.array(data, pa.binary()), lengths=own(np.diff(places)))


def _frequent_hashes(least: int):
    """For the packets of one range: back to each block, those of its hashes whose counts add up to ``least`` or more."""

    def run(packets: pa.Table) -> pa.Table:
        hashes = [np.cumsum(_unpacked(x)) for x in packets.column("hashes").to_pylist()]
        counts = np.concatenate([_unpacked(x) for x in packets.column("counts").to_pylist()])
        keys, place = np.unique(np.concatenate(hashes), return_inverse=True)
        enough = np.bincount(place, weights=counts, minlength=len(keys))[place] >= least
        ends = np.cumsum([0, *map(len, hashes)])
        left = [x[enough[a:b]] for x, a, b in zip(hashes, ends, ends[1:])]
        held = [i for i, x in enumerate(left) if len(x)]
        return pa.table({"block": packets.column("block").combine_chunks().take(pa.array(held, pa.int64())), "hashes": pa.array([_packed(_gaps(left[i])) for i in held], pa.binary())})

    return run


def _frequent(least: int):
    """For the phrases of one range: those whose counts add up to ``least`` or more."""

    def run(packets: pa.Table) -> pa.Table:
        texts = []
        for data, lengths in zip(packets.column("said").to_pylist(), packets.column("lengths").to_pylist()):
            places, held = np.cumsum(np.append(0, _unpacked(lengths))).astype(np.int32), _unpacked(data).astype(np.uint8)
            texts.append(pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(held)))
        said = pa.concat_arrays(texts).dictionary_encode()
        counts = np.concatenate([_unpacked(x) for x in packets.column("counts").to_pylist()])
        total = np.zeros(len(said.dictionary), np.int64)
        np.add.at(total, np.asarray(said.indices), counts)
        held = np.flatnonzero(total >= least)
        texts = [x.split("\n", 1) for x in said.dictionary.take(pa.array(held)).to_pylist()]
        columns = [pa.array([x[1] for x in texts], pa.string()), pa.array([x[0] for x in texts], pa.string()), pa.array([x[0].count(" ") + 1 for x in texts], pa.int32()), pa.array(total[held])]
        return pa.Table.from_arrays(columns, names=["lang", "phrase", "k", "f"])

    return run


def _texts(batch: pa.RecordBatch, block_bytes: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bytes, offsets and languages of a batch; texts longer than a block are cut where pieces end."""
    text = batch.column("text")
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    held = text.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    cuts = []
    for i in np.flatnonzero(np.diff(offsets) > block_bytes):
        ends = offsets[i] + np.flatnonzero(_CLASSES[data[offsets[i] : offsets[i + 1]]] == _SEPARATOR)
        cuts.append(np.unique(ends[np.searchsorted(ends, np.arange(offsets[i] + block_bytes, offsets[i + 1], block_bytes)) - 1]) if len(ends) else ends)
    more = np.concatenate([offsets, *cuts]) if cuts else offsets
    order = np.sort(more, kind="stable")
    owner = np.searchsorted(offsets, order[:-1], side="right") - 1
    return data, order, batch.column("lang").take(pa.array(np.minimum(owner, len(text) - 1)))


def _first_lists(texts: list[tuple[np.ndarray, np.ndarray, pa.Array]], block: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The words of a block with their positions."""
    data = _LOWER[np.concatenate([d for d, _, _ in texts])]
    sizes = np.cumsum([0, *(len(d) for d, _, _ in texts)])
    begins = np.concatenate([o[:-1] + base for (_, o, _), base in zip(texts, sizes)])
    langs = pa.chunked_array([x for _, _, x in texts]).combine_chunks().dictionary_encode()
    kinds = _CLASSES[data]
    word = kinds == _WORD
    edge = np.zeros(len(data) + 1, bool)
    edge[begins[begins < len(data)]] = True
    edge[len(data)] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    if not len(starts):
        return
    piece = np.cumsum((kinds == _SEPARATOR).astype(np.int32) + edge[:-1])[starts]
    at = np.arange(len(starts)) + np.cumsum(np.concatenate([[0], piece[1:] != piece[:-1]]))
    both = np.stack([starts, ends], axis=1).ravel().astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(both) - 1, pa.py_buffer(both), pa.py_buffer(data))
    names = pieces.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode()
    who = np.asarray(names.indices).astype(np.int64)
    spoken = np.asarray(langs.indices).astype(np.int64)[np.searchsorted(begins, starts, side="right") - 1]
    keys, who, counts = np.unique(spoken * len(names.dictionary) + who, return_inverse=True, return_counts=True)
    take = lambda texts, which: texts.dictionary.take(pa.array(which))
    words = pc.binary_join_element_wise(take(names, keys % len(names.dictionary)), take(langs, keys // len(names.dictionary)), "\n")
    rank = np.asarray(pc.sort_indices(pa.table({"n": counts, "word": words}), [("n", "descending"), ("word", "ascending")])).astype(np.int64)  # frequent words have small numbers
    words, keys, counts, number = words.take(pa.array(rank)), keys[rank], counts[rank], np.argsort(rank)
    yield _packets(block, _word_hashes(words), counts, parts, WORD_BITS)
    said = np.bincount(keys // len(names.dictionary), weights=counts, minlength=len(langs.dictionary)).astype(np.int64)
    yield _batch(len(said), block=pa.array(np.full(len(said), block)), lang=langs.dictionary, n=pa.array(said))
    yield _rest(block, at, number[who], None, words)


def _rest(block: int, at: np.ndarray, who: np.ndarray, begins: np.ndarray | None, words: pa.Array) -> pa.RecordBatch:
    """What is left of a block: which word is where, and where frequent phrases begin."""
    marks = None if begins is None else _packed(np.packbits(begins))
    texts = pa.array([_packed_texts(words)], pa.binary())
    return _batch(1, block=pa.array([block], pa.int64()), gaps=pa.array([_packed(_gaps(at))], pa.binary()), who=pa.array([_packed(who)], pa.binary()), begins=pa.array([marks], pa.binary()), words=texts)


def _word_lists(parts: int, block_bytes: int):
    """All blocks of a task, numbered by task and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets, langs = _texts(batch, block_bytes)
            low = 0
            while low < len(offsets) - 1:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + block_bytes - size, side="right")) - 1)
                held.append((data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], langs[low:high]))
                size += int(offsets[high] - offsets[low])
                low = high
                if size >= block_bytes or low < len(offsets) - 1:
                    yield from _first_lists(held, block, parts)
                    held, size, block = [], 0, block + 1
        if held:
            yield from _first_lists(held, block, parts)

    return run


def _lists(at: np.ndarray, who: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lists of all phrases of k words that begin at the marked places: places by list, list of each place, lengths, and each list's words."""
    i = np.flatnonzero(begins)
    owner, members = who[i], np.arange(who.max() + 1 if len(who) else 0)[:, None]
    for j in range(k):
        key = owner * (who.max() + 1) + who[i + j] if j else who[i]
        keys, owner = np.unique(key, return_inverse=True)
        members = np.concatenate([members[keys // (who.max() + 1)], (keys % (who.max() + 1))[:, None]], axis=1) if j else keys[:, None]
    order = np.argsort(owner, kind="stable")
    return at[i][order], owner[order], np.bincount(owner, minlength=len(members)), members


def extended(k: int, at: np.ndarray, who: np.ndarray, places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of the lists of phrases of k words with the postings of words k places on.

    Gives the places of the longer phrases by list, and their lists' phrases, words and lengths. What
    follows the first word must be a frequent phrase too, or the longer one cannot be frequent.
    """
    j = np.minimum(np.searchsorted(at, places + k), len(at) - 1)
    along = np.sort(places)
    i = np.minimum(np.searchsorted(along, places + 1), len(along) - 1)
    meets = (at[j] == places + k) & (along[i] == places + 1)
    size = int(who.max()) + 1
    key = owner[meets] * size + who[j[meets]]
    keys, lengths = np.unique(key, return_counts=True)
    return places[meets][np.argsort(key, kind="stable")], keys // size, keys % size, lengths


def _longer_lists(k: int, longest: int, parts: int, bits: int):
    """For one block, what is left of it and the hashes of frequent phrases of k words: counts of those, and packets of k + 1."""

    def run(state: pa.Table, frequent: pa.Table) -> pa.Table:
        if not state.num_rows or not frequent.num_rows:
            return _ROWS.empty_table()
        one = lambda name: state.column(name)[0]
        block, words = one("block").as_py(), _unpacked_texts(one("words").as_py())
        left = np.concatenate([np.cumsum(_unpacked(x)) for x in frequent.column("hashes").to_pylist()])
        at, who, own = np.cumsum(_unpacked(one("gaps").as_py())), _unpacked(one("who").as_py()), _word_hashes(words)
        if k == 1:
            known = np.isin(_short(own, WORD_BITS), left)
            new = np.cumsum(known) - 1
            held = known[who]
            at, who, words, own = at[held], new[who[held]], words.filter(pa.array(known)), own[known]
            begins = np.ones(len(at), bool)
        else:
            begins = np.unpackbits(_unpacked(one("begins").as_py()).astype(np.uint8), count=len(at)).astype(bool)
            places, owner, _, members = _lists(at, who, begins, k - 1)
            places, first, last, lengths = extended(k - 1, at, who, places, owner) if len(places) else (places, owner, owner, owner)
            known = np.isin(_short(_longer_hashes(_phrase_hashes(own, members)[first], own[last]), bits), left)
            begins = np.zeros(len(at), bool)
            begins[np.searchsorted(at, places[np.repeat(known, lengths)])] = True
        if not begins.any():
            return _ROWS.empty_table()
        places, owner, lengths, members = _lists(at, who, begins, k)
        hashes = _phrase_hashes(own, members)
        texts, tongues = (pc.list_element(pc.split_pattern(words, "\n", max_splits=1), i) for i in (0, 1))
        said = [texts.take(pa.array(members[:, i])) for i in range(k)]
        phrases = pc.binary_join_element_wise(pc.binary_join_element_wise(*said, " ") if k > 1 else said[0], tongues.take(pa.array(members[:, 0])), "\n")
        out = [_phrases(block, hashes, phrases, lengths, parts)]
        if k < longest:
            _, first, last, lengths = extended(k, at, who, places, owner)
            out.append(_packets(block, _longer_hashes(hashes[first], own[last]), lengths, parts, bits))
            near = np.isin(at, np.concatenate([places + i for i in range(k + 2)]))  # the phrases, and what the next two words can be
            out.append(_rest(block, at[near], who[near], begins[near], words))
        return pa.Table.from_batches(out, schema=_ROWS)

    return run


def _phrase_hashes(words: np.ndarray, members: np.ndarray) -> np.ndarray:
    hashes = words[members[:, 0]]
    for i in range(1, members.shape[1]):
        hashes = _longer_hashes(hashes, words[members[:, i]])
    return hashes


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f`` of all phrases of 1 to ``longest`` words with ``least`` or more occurrences, and ``lang, n`` of all words.

    Hashes are dealt by ranges, as many as the session has shuffle partitions; a range has a packet of each
    block at most, whatever is frequent. Each step is written to the shared folder, so a lost
    executor costs its tasks only, and removed when the next one is.
    """
    spark, folder, parts = docs.sparkSession, new_folder(docs.sparkSession, "phrases"), width(docs)
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), whole_text().alias("text"))
    step, found = in_small_batches(texts).mapInArrow(_word_lists(parts, block_bytes), _SCHEMA), []
    for k in range(1, longest + 2):
        step.write.option("compression", "zstd").parquet(f"{folder}/lists-{k}")
        rows = spark.read.schema(_SCHEMA).parquet(f"{folder}/lists-{k}")
        if k == 1:
            totals = checkpointed(rows.where("n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")))
            bits = bits or hash_bits(totals.agg(F.sum("n")).first()[0] or 0, least)
        else:
            said = rows.where("said IS NOT NULL").select("part", "said", "lengths", "counts")
            found.append(checkpointed(said.groupBy("part").applyInArrow(_frequent(least), "lang string, phrase string, k int, f long")))
            remove_folder(spark, f"{folder}/lists-{k - 1}")
        if k <= longest:
            packets = rows.where("hashes IS NOT NULL").select("part", "block", "hashes", "counts")
            frequent = packets.groupBy("part").applyInArrow(_frequent_hashes(least), "block long, hashes binary")
            state = rows.where("words IS NOT NULL").select("block", "gaps", "who", "begins", "words")
            step = state.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(_longer_lists(k, longest, parts, bits), _SCHEMA)
    remove_folder(spark, folder)
    phrases = found[0]
    for df in found[1:]:
        phrases = phrases.unionByName(df)
    return phrases, totals


def collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, absorbed: int = ABSORBED_PERCENT, shown: int = SHOWN, **settings: int) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase's score is that of its worst cut: 1000 a n / (l r), rounded down, in exact decimals
    of 38 digits. A phrase goes if one that is longer by a word and holds it has ``absorbed``
    percent of its occurrences or more; with that, so does any longer one. Null ``lang`` is
    ``und``, a null text the empty text; repeated rows count as often as they are there;
    texts of any length are read whole; ties are settled by the phrase's bytes; an empty
    table gives an empty result; other columns are not looked at.
    """
    phrases, totals = frequent_phrases(docs, least, longest, **settings)
    words = F.split("phrase", " ")
    joined = lambda low, n: F.array_join(F.slice("words", low, n), " ")
    several = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("words"))
    inner = several.where("k > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("k") - 1), joined(F.lit(2), F.col("k") - 1))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = several.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True)))
    cuts = own.select("lang", "phrase", "k", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = lambda side, f: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(sent(totals), "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r", "n")).alias("x"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = worst.select("lang", "phrase", "x.*").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= shown)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
