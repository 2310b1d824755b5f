"""Near-duplicate documents by DartMinHash signatures, banding and exact verification.

Every element (a shingle of five words) owns a strip of the plane of weight and rank, cut
into unit cells; a hash decides how many darts hit a cell (Poisson with mean 1) and each
dart's rank and coordinate. A signature keeps the earliest dart of each coordinate, so one
pass over a document's cells, about as many as it has elements or k log k, gives all k
coordinates. An element weighs as much as the document has it often; two signatures agree
in a coordinate with the probability of the weighted Jaccard similarity. Documents that
share a band are candidates; every link is verified on the shingles of the whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpointed, in_small_batches, released, sent, squeezed, whole_text, width

WORDS, SIMILARITY = 5, 0.8
#: 25 bands of 5: a pair at similarity 0.8 shares a band with probability 0.99995.
BANDS, ROWS = 25, 5
K = BANDS * ROWS
#: Cells of the plane that are thrown at at once.
CELLS = 1 << 18
#: Nodes of a bucket meet in blocks of about so many.
BLOCK = 1024
#: Coordinates that must agree before a pair's shingles are compared; a pair at 0.8 has fewer with probability below 1e-6.
AGREE = 75
_MORE = np.uint64(0x9E3779B97F4A7C15)
_FIND = re.compile(WORD)
#: Distribution function of the Poisson distribution with mean 1, up to 12 darts a cell.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.maximum(1, np.arange(13))))[:-1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's windows of WORDS words, ascending, and how often it has each.

    A text of fewer words is one window, an empty one has none.
    """
    words = _FIND.findall(text)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - WORDS + 1, min(1, len(h)))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(WORDS, len(h))):
            out = mixed(out + _MORE) + h[i : i + n]
    return np.unique(mixed(out), return_counts=True)


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the smaller counts over the larger ones; without repeated shingles that of the sets."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(one[1][i], two[1][j]).sum())
    return both / max(1, int(one[1].sum()) + int(two[1].sum()) - both)


def dart_signatures(elements: np.ndarray, sizes: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """One row of k coordinates per set; ``elements`` are the sets' members one after the other.

    ``weights`` are whole numbers from 1 (default: all 1). Sets must not be empty. Cells
    are worked on in blocks of about CELLS, so that a very large set needs no more memory.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    layer = np.zeros(len(elements), np.uint64)
    if weights is not None and (weights > 1).any():
        doc, elements = np.repeat(doc, weights), np.repeat(elements, weights)
        layer = (np.arange(len(elements)) - np.repeat(np.cumsum(weights) - weights, weights)).astype(np.uint64)
    with np.errstate(over="ignore"):
        strips = mixed(elements + mixed(layer + np.uint64(1)))
    area = np.bincount(doc, minlength=len(sizes))
    first = np.zeros(len(sizes), np.int64)
    last = np.ceil(k * (np.log(k) + 2) / area).astype(np.int64)  # ranks up to here leave about 0.1 coordinates empty
    rank, dart, open_ = np.full(len(sizes) * k, np.inf), np.zeros(len(sizes) * k, np.uint64), np.ones(len(sizes), bool)
    while open_.any():
        own = np.flatnonzero(open_[doc])
        cells = np.cumsum((last - first)[doc[own]])
        for block in np.split(own, np.searchsorted(cells, np.arange(CELLS, cells[-1], CELLS))):
            ranks = (last - first)[doc[block]]
            cell = np.repeat(block, ranks)
            r = np.arange(len(cell)) - np.repeat(np.cumsum(ranks) - ranks, ranks) + first[doc[cell]]
            with np.errstate(over="ignore"):
                h = mixed(strips[cell] ^ mixed(r.astype(np.uint64) * _MORE + np.uint64(1)))
            darts = np.searchsorted(_POISSON, (h >> np.uint64(11)) * 2.0**-53, side="right")
            hit = np.repeat(np.arange(len(cell)), darts)
            j = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
            with np.errstate(over="ignore"):
                d = mixed(h[hit] + (j + 1).astype(np.uint64) * _MORE)
            at = doc[cell[hit]] * k + (d % np.uint64(k)).astype(np.int64)
            when = r[hit] + (mixed(d) >> np.uint64(11)) * 2.0**-53
            before = rank[at]
            np.minimum.at(rank, at, when)
            won = (when == rank[at]) & (when < before)
            dart[at[won]] = d[won]
        open_ = np.isinf(rank.reshape(-1, k)).any(1)
        first, last = last, last * 2
    return dart.reshape(-1, k)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            keys = mixed(keys * _MORE + rows[:, :, i])
    return keys.view(np.int64)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts to band keys and the lowest byte of each coordinate, some texts at a time; both are empty for a text without words."""
    hashes = _Hashes()
    for batch in batches:
        bands: list = [np.zeros(0, np.int64)] * len(batch)
        marks = [b""] * len(batch)
        held: list = []
        size = 0
        for i, text in enumerate([*batch["text"], None]):
            if text is not None and len((own := shingles(text, hashes))[0]):
                held.append((i, *own))
                size += len(own[0]) + 900
            if held and (text is None or size > 1 << 16):
                signatures = dart_signatures(np.concatenate([x for _, x, _ in held]), np.array([len(x) for _, x, _ in held]), np.concatenate([w for *_, w in held]))
                for (at, *_), keys, signature in zip(held, band_keys(signatures), signatures.astype(np.uint8)):
                    bands[at], marks[at] = keys, signature.tobytes()
                held, size = [], 0
        yield batch.drop(columns="text").assign(bands=bands, marks=marks)


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs with texts to those at SIMILARITY or more."""
    hashes = _Hashes()
    last, own = None, None
    for batch in batches:
        keep = []
        for a, b in zip(batch["text_a"], batch["text_b"]):
            if a != last:
                last, own = a, shingles(a, hashes)
            keep.append(similarity(own, shingles(b, hashes)) >= SIMILARITY - 1e-9)
        yield batch.loc[keep, ["a", "b"]]


def texts_of(ids: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, text`` of the nodes ``ids``: the text of the row that stands for each.

    The places of those rows (id and hash of the text) are short; they are broadcast if
    they are few, which is checked, else the texts are shuffled to them. Rows that repeat
    id and text, however many, count once.
    """
    places = checkpointed(ids.join(nodes.select("id", "doc_id", "v"), "id").select("id", F.col("doc_id").alias("_doc_id"), F.col("v").alias("_v")))
    found = texts.join(sent(places), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("v") == F.col("_v")))
    return found.select("id", "text").dropDuplicates(["id"])


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough; only texts that a pair names are moved."""
    own = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), nodes, texts)
    one = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return in_small_batches(two.select("a", "b", "text_a", "text_b")).mapInPandas(_verified, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, class_id`` of each end of an edge (a, b): the smallest id that it is connected with.

    Labels move along edges and along the labels themselves, in one join, until none
    changes, so even long chains take few rounds; each round is cut off by a checkpoint.
    """
    both = checkpointed(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct())
    labels = checkpointed(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("class_id")))
    ways = both.withColumn("class_id", F.lit(None).cast(labels.schema["class_id"].dataType))
    while True:
        hops = ways.unionByName(labels.select("id", F.col("class_id").alias("to"), "class_id"))
        near = labels.select(F.col("id").alias("to"), F.col("class_id").alias("near"))
        labels = checkpointed(hops.join(near, "to").groupBy("id").agg(F.max("class_id").alias("class_id"), F.min("near").alias("next")))
        changed = labels.where("class_id <> next").limit(1).count()
        labels = labels.select("id", F.col("next").alias("class_id"))
        if not changed:
            return labels


def joined(labels: DataFrame, late: DataFrame) -> DataFrame:
    """The components of edges whose components are ``labels`` and of the edges ``late`` together.

    Only the ends of late edges and the classes that they are in meet; all others keep
    their label or follow their class.
    """
    ends = late.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left")
    ends = checkpointed(ends.select("id", F.coalesce("class_id", "id").alias("class_id"), F.col("class_id").isNull().alias("new")))
    over = components(late.unionByName(ends.where("not new").select(F.col("id").alias("a"), F.col("class_id").alias("b"))))
    over = over.select(F.col("id").alias("class_id"), F.col("class_id").alias("next"))
    everyone = labels.unionByName(ends.where("new").select("id", "class_id"))
    return checkpointed(everyone.join(over, "class_id", "left").select("id", F.coalesce("next", "class_id").alias("class_id")))


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts to their shingles and counts."""
    hashes = _Hashes()
    for batch in batches:
        found = [shingles(t, hashes) for t in batch["text"]]
        yield pd.DataFrame({"id": batch["id"], "shingles": [x.tobytes() for x, _ in found], "counts": [n.astype("<i4").tobytes() for _, n in found]})


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of key and two blocks ``(p, q)``, those of one meeting at a time."""
    held: list = []
    own = None
    for batch in batches:
        place = batch[["key", "p", "q"]].to_numpy(np.int64)
        cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1)]) if len(batch) else []
        for start, stop in zip(cuts, [*cuts[1:], len(batch)]):
            if held and tuple(place[start]) != own:
                yield pd.concat(held, ignore_index=True)
                held = []
            own = tuple(place[start])
            held.append(batch.iloc[start:stop])
    if held:
        yield pd.concat(held, ignore_index=True)


def _partners(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a meeting with the later rows that are to be compared with it.

    These are of another class and block (or of the one block that meets itself), agree
    in AGREE coordinates, and have no earlier band in common.
    """
    key, p, q = (int(rows[c].iloc[0]) for c in ("key", "p", "q"))
    bands = np.stack(rows["bands"].to_list())
    marks = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(len(rows), K)
    classes, block = rows["class_id"].to_numpy(np.int64), rows["block"].to_numpy(np.int64)
    band = (bands == key).argmax(1)[0]
    for i in range(len(rows) - 1):
        later = np.flatnonzero((classes[i + 1 :] != classes[i]) & ((block[i + 1 :] != block[i]) | (p == q))) + i + 1
        later = later[(marks[later] == marks[i]).sum(1) >= AGREE]
        yield i, later[~(bands[later, :band] == bands[i, :band]).any(1)]


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Meetings to their rows that have a partner."""
    out, size = [], 0
    for rows in _meetings(batches):
        named = np.zeros(len(rows), bool)
        for i, partners in _partners(rows):
            named[partners] = True
            named[i] |= len(partners) > 0
        if named.any():
            out.append(rows[named])
            size += int(named.sum())
        if size > 5_000:
            yield pd.concat(out)
            out, size = [], 0
    if out:
        yield pd.concat(out)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Meetings with shingles to pairs at SIMILARITY or more that join two classes."""
    for rows in _meetings(batches):
        sets = [(np.frombuffer(x, np.uint64), np.frombuffer(n, "<i4")) for x, n in zip(rows["shingles"], rows["counts"])]
        ids = rows["id"].tolist()
        _, now = np.unique(rows["class_id"].to_numpy(np.int64), return_inverse=True)  # classes as joined in this meeting
        found = []
        for i, partners in _partners(rows):
            for j in partners:
                if now[i] != now[j] and similarity(sets[i], sets[j]) >= SIMILARITY - 1e-9:
                    now[now == now[j]] = now[i]
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        yield pd.DataFrame(found, columns=["a", "b"])


def settled(crowded: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between classes from all pairs of each bucket that are in two classes.

    ``crowded`` has ``key, id, a``; the pairs with ``a``, the bucket's first node, are
    done. Every two blocks of a bucket's other nodes meet in one group, so a large bucket
    is dealt over many tasks. Signatures meet first; shingles of the nodes that have a
    partner then meet in the same groups. A pair is looked at in the first band that it
    shares, once, and not at all if its classes were joined on the way.
    """
    placed = crowded.where("id <> a").join(labels, "id", "left").select("key", "id", F.xxhash64(F.coalesce("class_id", "id")).alias("class_id"))
    split = placed.groupBy("key").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n")
    open_ = checkpointed(placed.join(split, "key"))
    blocks = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
    dealt = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "class_id", "block")
    columns = "key long, p long, q long, id binary, class_id long, block long, bands array<long>, marks binary"

    def met(rows: DataFrame) -> DataFrame:
        return in_small_batches(rows.repartition(width(texts), "key", "p", "q").sortWithinPartitions("key", "p", "q", "id"))

    names = [c.split()[0] for c in columns.split(", ")]
    suspects = checkpointed(met(dealt.join(nodes.select("id", "bands", "marks"), "id").select(*names)).mapInPandas(_suspects, columns))
    sets = checkpointed(in_small_batches(texts_of(suspects.select("id").distinct(), nodes, texts)).mapInPandas(_shingled, "id binary, shingles binary, counts binary"))
    return met(suspects.join(sets, "id")).mapInPandas(_linked, "a binary, b binary").distinct()


def node_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows as ``doc_id, v, id`` and nodes as ``id, rep_id, head, class_id, class_links``, both checkpoints.

    A node is a text as a sequence of words, ``id`` its 128-bit hash, ``rep_id`` the
    smallest document id that has it. ``head`` is the node of its class with the smallest
    ``rep_id`` (null last), which is the class's ``class_id``; ``class_links`` is the
    number of links between different texts of the class that were verified.
    """
    text = whole_text(text_column)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("v"), text.alias("text"))
    id_ = F.unhex(F.md5(F.trim(squeezed(F.col("text"))).cast("binary"))).alias("id")
    signed = checkpointed(in_small_batches(texts.select("doc_id", "v", id_, "text")).mapInPandas(_signed, "doc_id long, v long, id binary, bands array<long>, marks binary"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v")
    nodes = signed.groupBy("id").agg(F.min(place).alias("x"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    nodes = checkpointed(nodes.select("id", "x.doc_id", "x.v", "bands", "marks"))
    keyed = nodes.where("size(bands) > 0").select("id", "doc_id", F.explode("bands").alias("key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id"))
    buckets = checkpointed(keyed.groupBy("key").agg(first.alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("x.id").alias("a")))
    crowded = checkpointed(keyed.join(buckets, "key").select("key", "id", "a"))  # nodes that share a bucket with another
    pairs = checkpointed(crowded.where("id <> a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct())
    edges = checkpointed(verified(pairs, nodes, texts))
    labels = released(components(edges))

    late = released(checkpointed(settled(crowded, labels, nodes, texts)))
    if late.limit(1).count():
        edges = edges.unionByName(late)
        labels = joined(labels, late)
    own = nodes.select("id", F.col("doc_id").alias("rep_id")).join(labels, "id", "left").select("id", "rep_id", F.coalesce("class_id", "id").alias("label"))
    heads = own.groupBy("label").agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "id")).alias("x"))
    links = edges.join(labels.select(F.col("id").alias("a"), "class_id"), "a").groupBy(F.col("class_id").alias("label")).agg(F.count(F.lit(1)).alias("class_links"))
    heads = checkpointed(heads.join(links, "label", "left").select("label", F.col("x.id").alias("head"), F.col("x.rep_id").alias("class_id"), F.coalesce("class_links", F.lit(0).cast("long")).alias("class_links")))
    return signed.select("doc_id", "v", "id"), checkpointed(own.join(heads, "label").drop("label"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, rep_id, class_links``.

    Texts with the same words in the same order are one node, named by the smallest id
    that has it (``rep_id``), however many copies there are; ``class_id`` is the smallest
    id of the class and ``class_links`` the number of verified links between its
    different texts. In each band's bucket every node is compared with the first one;
    then every pair of a bucket that is still in two classes is settled (see
    :func:`settled`).

    Nodes are texts, not ids: rows of one id with different texts are told apart (their
    classes may have one ``class_id``). Null and empty texts are copies of one another;
    rows without id take part, and ``rep_id`` or ``class_id`` is null where no row has an
    id. Rows that repeat come out alike; texts of any length are compared whole; an empty
    table gives an empty result; other columns are not looked at.
    """
    rows, nodes = node_classes(docs, id_column, text_column)
    return rows.join(nodes, "id").select("doc_id", "class_id", "rep_id", "class_links")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each class the row of the smallest id.

    Rows go by id and text, so other texts of an id stay. Rows that repeat the id and the
    words of the one that stays all stay, as do rows without id where no row of their
    class has one.
    """
    rows, nodes = node_classes(docs, id_column, text_column)
    stays = (F.col("id") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    gone = rows.join(nodes, "id").where(~stays).select(F.col("doc_id").alias("_doc_id"), F.col("v").alias("_v")).distinct()
    own = docs[id_column].cast("long").eqNullSafe(F.col("_doc_id")) & (F.xxhash64(whole_text(docs[text_column])) == F.col("_v"))
    return docs.join(sent(checkpointed(gone)), own, "left_anti")
