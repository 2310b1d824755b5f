"""The registered queries over the smallest tables, against SQL, and the pipeline stage by stage."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from ledgerloom.llm.queries import QUERIES, SQL

from .conftest import edge_rows, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def bag(rows):
    return Counter(tuple(map(str, r)) for r in rows)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(SQL[name]), QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert bag(got.select(*columns).collect()) == bag(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_learnt_labels_are_those_of_training_rows_only(spark, tmp_path):
    """Held-out labels change nothing."""
    from ledgerloom.llm import quality_classifier, toxicity
    from ledgerloom.llm.common import held_out
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.select("doc_id", *[F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    for f in (quality_classifier.classify, toxicity.tag):
        one, two = ({r["row"]["doc_id"]: round(r["score"], 9) for r in f(docs, x).collect()} for x in (labels, other))
        assert one == two


@pytest.mark.parametrize(("name", "label", "least", "area"), [("op2_quality_classifier", "quality", 0.97, 0.98), ("op10_toxicity", "toxic", 0.98, 0.96)])
def test_held_out_accuracy(spark, name, label, least, area):
    """Accuracy and area under the curve of the query on rows that no label was learnt from, from the raw labels."""
    import zlib

    sf = "/root/testdata/sf0.1"  # 825 such rows
    truth = dict(duckdb.sql(f"select doc_id, {label} from '{sf}/labels.parquet' where {label} is not null").fetchall())
    rows = [r for r in QUERIES[name](spark, sf).collect() if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) > 500 and all(r["held_out"] for r in rows)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)
    one, none = ([r["score"] for r in rows if truth[r["doc_id"]] == y] for y in (1, 0))
    order = sum((a > b) + 0.5 * (a == b) for a in one for b in none) / (len(one) * len(none))
    assert right >= least and order >= area, (right, order)


def test_toxic_spans_are_places_in_the_text(spark):
    """Lower case may be longer than the text; offsets are those of the text itself."""
    from ledgerloom.llm import toxicity

    train = [(f"calm words number {i} here and there", 0) for i in range(40)] + [(f"calm words vilething {i} here", 1) for i in range(20)]
    model = toxicity.fit([t for t, _ in train], __import__("numpy").array([float(y) for _, y in train]))
    text = "İİİ calm VileThing here"
    _, spans = toxicity.tag_texts([text], model)
    assert "VileThing" in [text[int(a) : int(b)] for a, b in (s.split(":") for s in spans[0].split(",") if s)]


def test_contradicting_labels_are_settled_alike(spark):
    from ledgerloom.llm.common import known_labels

    rows = [(1, 0), (1, 1), (2, 0), (3, 5), (4, None), (None, 1)]
    got = {tuple(r) for r in known_labels(spark.createDataFrame(rows, "doc_id long, quality int").repartition(3), "quality").collect()}
    assert got <= {(1, 1), (2, 0)} and got


def test_pipeline_stages_against_brute_force(spark, edge, labels, tmp_path):
    import corpus_pipeline
    from ledgerloom.llm import quality_classifier

    from .test_edge_cases import brute_classes, squeezed, targets

    docs, columns = edge, edge.columns  # null ids and clashing names included
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]

    def rows(df):
        assert df.columns == columns
        return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]

    kept = rows(stages["quality"](spark, docs, str(tmp_path)))
    scored = quality_classifier.classify(docs, labels).where("score >= 0.3").select("row.doc_id", "row.text", "row.source").collect()
    assert bag(kept) == bag(scored)

    first = {}
    given = edge_rows()
    for i, t, _ in given:
        if i is not None:
            first[squeezed(t)] = min(i, first.get(squeezed(t), i))
    own = rows(stages["exact_dedup"](spark, docs, ""))
    assert bag(own) == bag(r for r in given if first.get(squeezed(r[1])) == r[0])

    near = rows(stages["near_dedup"](spark, docs, ""))
    classes = dict(zip(range(len(given)), brute_classes(given)))
    assert bag(near) == bag(r for k, r in enumerate(given) if classes[k][1] == r[0])

    mixed, sizes = rows(stages["mixing"](spark, docs, "")), Counter()
    for _, t, s in given:
        sizes[s] += len(words(t))
    taken = Counter()
    for _, t, s in mixed:
        taken[s] += len(words(t))
    assert all(abs(taken[s] - target) <= 0.5 for s, target in targets(sizes).items())

    packed = stages["packing"](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == {i for i, _, _ in given}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 0
