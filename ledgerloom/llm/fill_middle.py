"""Fill-in-the-middle transformation: documents cut in three, with the middle moved to the end.

A kernel works on a whole Arrow batch of texts at once, on its UTF-8 bytes and offsets, and
never decodes a text. Each byte gets a class by table lookup; a second table says for the
classes of two adjacent bytes whether a unit (code point, word or line) begins between them;
cumulative sums of that mask, less their value where a document begins, number the units;
one ``searchsorted`` finds the bytes of all cuts of the batch. The pieces are views of the
batch's buffer, and Arrow joins them. What decides the form and the cuts is hashed from the
document's id by Spark, so reruns and repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches, rows_of, with_text

#: The marks before prefix, suffix and middle, and the names of the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ("plain", "psm", "spm")
#: Of 100 documents so many are transformed, and of 100 of these so many begin with the suffix.
MOVED, SUFFIX_FIRST, SEED = 90, 20, 1
#: Classes of bytes; EDGE stands for what is before a document.
CONTINUED, LETTER, BLANK, NEWLINE, EDGE = range(5)
CLASSES = np.full(256, LETTER, np.uint8)
CLASSES[0x80:0xC0] = CONTINUED
CLASSES[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = BLANK
CLASSES[0x0A] = NEWLINE


def _boundaries(unit: str) -> np.ndarray:
    """For the classes of two adjacent bytes, whether a unit begins with the second; a document's first byte begins one.

    A word takes the white space before it along, a line ends with its line feed.
    """
    before, after = np.indices((5, 5))
    lead = after != CONTINUED
    blank = (after == BLANK) | (after == NEWLINE)
    begins = {"code_point": lead, "word": lead & blank & (before != BLANK) & (before != NEWLINE), "line": lead & (before == NEWLINE)}[unit]
    return begins | (before == EDGE)


def cut_batch(text: pa.Array, one: np.ndarray, two: np.ndarray, form: np.ndarray, unit: str = "code_point") -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Units, units before the two cuts, and the output of each text of a batch; the cuts are two numbers modulo the units and one."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    held = text.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    classes = CLASSES[data]
    before = np.concatenate([[EDGE], classes[:-1]]).astype(np.uint8)[: len(data)]
    before[offsets[:-1][offsets[:-1] < offsets[1:]]] = EDGE
    begun = np.concatenate([[0], np.cumsum(_boundaries(unit)[before, classes])])  # units begun before each byte
    start = begun[offsets[:-1]]
    units = begun[offsets[1:]] - start
    first, second = one % (units + 1), two % (units + 1)
    first, second = np.minimum(first, second), np.maximum(first, second)
    # The unit after k others of its document is the one that makes the sum start + k + 1.
    places = np.searchsorted(begun[1:], np.concatenate([start + first, start + second]) + 1)
    cuts = np.minimum(places, np.concatenate([offsets[1:], offsets[1:]])).reshape(2, -1)
    ends = np.append(np.stack([offsets[:-1], cuts[0], cuts[1]], axis=1).ravel(), offsets[-1]).astype(np.int32)
    pieces = pa.StringArray.from_buffers(3 * len(text), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    order = 3 * np.arange(len(text))[:, None] + np.array([(0, 1, 2), (0, 2, 1), (2, 0, 1)])[form]  # of prefix 0, middle 1 and suffix 2
    marks = np.array([("", "", ""), (PREFIX, SUFFIX, MIDDLE), (SUFFIX, PREFIX, MIDDLE)])[form]
    parts = [x for i in range(3) for x in (pa.array(marks[:, i].tolist(), pa.string()), pieces.take(pa.array(order[:, i])))]
    return units, first, second, pc.binary_join_element_wise(*parts, "")


def fill_in_middle(docs: DataFrame, moved: int = MOVED, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, unit: str = "code_point") -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``n`` units, ``form``, ``prefix_units``, ``middle_units`` and ``output``.

    A text that is empty (or null) or holds a mark stays plain, as do 100 less ``moved`` of
    100 others; a null id hashes as no digits. Rows that repeat are cut alike. Texts of
    any length are cut whole (a batch is one long text, or at most 4 MB of short ones); no
    row is dropped, an empty table gives an empty result, and further columns, whatever
    they are called, pass through in ``row``. No shuffle, one pass.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashed = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = with_text(docs.select("*", F.struct(*hashed).alias("\0hashes")))
    mark, names = rows.columns[-2], rows.columns[:-2]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col(f"{mark}.h3") % 100 >= moved), 0).when(F.col(f"{mark}.h4") % 100 < suffix_first, 2).otherwise(1)
    rows = rows.select(*names, F.col(f"{mark}.h1").alias("one"), F.col(f"{mark}.h2").alias("two"), form.alias("form"), "text")
    kept = [rows.schema[name] for name in names]
    added = [T.StructField("n", T.LongType()), T.StructField("form", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("second", T.LongType()), T.StructField("output", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two, forms = (batch.column(name).to_numpy() for name in ("one", "two", "form"))
                units, first, second, output = cut_batch(batch.column("text"), one, two, forms, unit)
                columns = [*(batch.column(name) for name in names), *map(pa.array, (units, forms, first, second)), output]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n", "form", "first", "second", "output"])

    done = in_small_batches(rows).mapInArrow(run, T.StructType([*kept, *added]))
    is_moved = F.col("form") > 0
    return done.select(
        rows_of(docs), "n", F.element_at(F.array(*map(F.lit, FORMS)), F.col("form") + 1).alias("form"),
        F.when(is_moved, F.col("first")).alias("prefix_units"), F.when(is_moved, F.col("second") - F.col("first")).alias("middle_units"), "output",
    )


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone."""
    piece = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(piece, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
