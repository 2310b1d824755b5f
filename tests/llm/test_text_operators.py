"""Phrases, chat formatting and fill-in-the-middle against brute force, on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, fill_middle, phrases

# Fill-in-the-middle.


def brute_cut(doc_id, text, moved=90, first=20):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= moved:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < first:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_cuts_of_awkward_rows(spark, edge):
    more = [(200 + i, t, "s") for i, t in enumerate(["<", "a<P", "x<P>y", "<S>", "S>", "😀" * 50 + "é", "\u0000a", "a\r\n" * 9, "P><M", "漢" * 70_000, "x" * 6_000_000])]
    docs = edge.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    got = fill_middle.fill_in_middle(docs)
    rows = got.select("row.doc_id", "row.text", "row.lang", "n", "form", "prefix_units", "middle_units", "output", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(rows) == docs.count() and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) == brute_cut(r["doc_id"], r["text"]) and r["back"] == (r["text"] or "")
    assert got.select("row.*").columns == docs.columns
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit, pattern", [("code_point", r"(?s)."), ("word", r"(?s)^[\t-\r ]*[^\t-\r ]*|[\t-\r ]+[^\t-\r ]*"), ("line", r"(?s)[^\n]*\n|[^\n]+$")])
def test_units_of_a_batch(unit, pattern):
    rng = random.Random(1)
    texts = ["", *("".join(rng.choice("ab é漢😀\n\n\t  ") for _ in range(rng.randrange(40))) for _ in range(300)), "", ""]
    one, two = (np.array([rng.randrange(2**32) for _ in texts]) for _ in range(2))
    whole = pa.array(["skipped", *texts, "skipped"])
    units, first, second, out = fill_middle.cut_batch(whole[1:-1], one, two, np.full(len(texts), 1), unit)
    for i, t in enumerate(texts):
        cut = [x for x in re.findall(pattern, t) if x]
        assert "".join(cut) == t and units[i] == len(cut)
        a, b = sorted((int(one[i]) % (len(cut) + 1), int(two[i]) % (len(cut) + 1)))
        assert (first[i], second[i]) == (a, b) and out[i].as_py() == f"<P>{''.join(cut[:a])}<S>{''.join(cut[b:])}<M>{''.join(cut[a:b])}"


# Chat formatting.


def test_any_text_is_read_back(spark):
    rng = random.Random(2)
    tokens = ["<", "[", "\\", "/", "s>", "INST]", "SYS]", "ROLE]", "TEXT]", "IMG]", "[INST]", "</s>", "<s>", "[\\IMG]", "x", "\n", " ", "é", "]"]
    text = lambda: "".join(rng.choice(tokens) for _ in range(rng.randrange(9)))
    roles = ["user", "assistant", "system", "tool", "", None, "[/ROLE]", "a[TEXT]b", "user\n"]
    rows = [(i // 4, i % 4, rng.choice(roles), rng.choice([None, text(), text(), text()])) for i in range(1200)] + [(None, 0, "user", "no id"), (900, None, "assistant", "b"), (900, None, "assistant", "a"), (900, 1, "user", "u"), (900, 1, "user", "u")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    formatted = chat.format_conversations(turns)
    said = {r["conv_id"]: r for r in formatted.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("formatted"), F.col("loss_mask")).alias("learnt")).collect()}
    want = defaultdict(list)
    for c, t, role, x in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[3] or "")):
        want[c].append((role or "", x or ""))
    assert set(said) == set(want)
    for c, turns_of in want.items():
        r = said[c]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns_of
        assert r["learnt"] == "".join(x for role, x in turns_of if role == "assistant")
        assert len(r["loss_mask"]) == len(turns_of)
    digests = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    whole = "".join(f"{a}\n{b}\n" for a, b in want[900])
    assert digests[900]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and digests[900]["n_turns"] == 4


def test_parts_become_placeholders(spark):
    part = lambda **x: {k: x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    parts = [
        [part(type="text", text="look ["), part(type="text", text="INST] "), part(type="image", ref="a.png", width=57, height=28), part(type="image", ref="b.png"), part(type="text", text="[IMG]")],
        [part(type="audio", ref="c.wav", seconds=2.0), part(type="text", text="ok"), part(type="document", ref="d.pdf", pages=3), None, part(type="video", text="?"), part(type="text")],
        None, [],
    ]
    rows = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], p) for i, p in enumerate(parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_conversations(rows).first()
    assert r["formatted"] == "<s>[INST]look [\\INST] [IMG][IMG][\\IMG][/INST][AUDIO]ok[DOC]?</s>[INST][/INST]</s>"
    assert [tuple(a) for a in r["attachments"]] == [("image", "a.png", 3), ("image", "b.png", 1), ("audio", "c.wav", 25), ("document", "d.pdf", 2304)] and r["media_tokens"] == 2333
    back = chat.format_conversations(rows).select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["text"], t["attached"]) for t in back] == [("look [INST] [IMG]", 2), ("ok?", 2), ("", 0), ("", 0)]


def test_one_long_conversation_takes_linear_time(spark):
    import time

    seconds = []
    for n in (4000, 16000):
        rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('word [INST] ', 20) as text", "id as segment", "id as content", "id as x")
        began = time.perf_counter()
        r = chat.digests(chat.format_conversations(rows)).first()
        seconds.append(time.perf_counter() - began)
        assert r["n_turns"] == n and r["loss_chars"] == n // 2 * 240
    assert seconds[1] < 8 * seconds[0] + 5, seconds
    assert chat.format_conversations(rows.limit(0)).count() == 0


# Phrases.


def brute_collocations(rows, least, longest=5, shown=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[(lang, tuple(words[i : i + k]))] += 1
    kept = {p: c for p, c in f.items() if c >= least}
    inside = defaultdict(int)
    for (lang, p), c in kept.items():
        for k in range(1, len(p)):
            for i in range(len(p) - k + 1):
                inside[(lang, p[i : i + k])] = max(inside[(lang, p[i : i + k])], c)
    out = defaultdict(list)
    for (lang, p), a in kept.items():
        if len(p) > 1 and not 100 * inside[(lang, p)] >= 100 * a:
            score, cut = min((1000 * a * n[lang] // (f[(lang, p[:k])] * f[(lang, p[k:])]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[(lang, p[:cut])], f[(lang, p[cut:])]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:shown])}


def phrase_rows():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "B", "b", "c", "dé", "ÀB", "x-y", "漢", "I", "1"])
    text = lambda: "".join(word() + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\v", "!?"]) for _ in range(rng.randrange(60)))
    rows = [(rng.choice(["en", "en", "fr", None, "und", "a\nb", ""]), text()) for _ in range(150)]
    return rows + [("en", None), (None, ""), ("en", " \t\n"), ("en", "a b c a b c. a b c"), *[("en", "say that again, please")] * 9, ("xx", "a " * 300), ("xx", "b c " * 200)]


@pytest.mark.parametrize("least, longest, settings", [(2, 5, {}), (9, 5, {"block_bytes": 100}), (5, 3, {"block_bytes": 40, "bits": 5}), (400, 5, {})])
def test_collocations_of_awkward_rows(spark, least, longest, settings):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(7) for c in ("phrase", "block", "n", "k", "f", "rank")}).repartition(3)
    got = {tuple(r) for r in phrases.collocations(docs, least, longest, shown=60, **settings).collect()}
    assert got == brute_collocations(rows, least, longest, 60) and (got or least == 400)


def test_phrases_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "."), (None, None)], docs.schema), 1).count() == 0


def test_scores_beyond_64_bits():
    """The decimals of the score hold counts of a corpus of 10^13 words."""
    a, n, left, right = 10**10, 10**13, 10**11, 10**12
    assert math.log2(1000 * a * n) > 64 and 1000 * a * n // (left * right) == 1000


# Secret scans of long texts.


def test_places_of_very_many_strings(spark):
    """A text with 100,000 strings, some of them in base spans, in bounded time; places by a plain search."""
    import time

    from ledgerloom.llm import secrets

    rng = random.Random(8)
    token = lambda n: "".join(rng.choice("ABCDEFGHabcdefgh0123456789") for _ in range(n))
    texts = ["\n".join(("password=" if i % 7 == 0 else "é ") + token(25) for i in range(n)) for n in (1, 64, 65, 5000, 100_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert time.perf_counter() - began < 60
    for i, t in enumerate(texts):
        base = [(m.start(), m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 8]
        said = ",".join(f"assign:{a}:{b}" for a, b in base)
        assert got[i]["n_assign"] == len(base) and got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        taken, strings = set(x for a, b in base for x in range(a, b)), {(m.start(), m.end()) for m in re.finditer(secrets.STRING, t)}
        added = [tuple(map(int, x.split(":")[1:])) for x in got[i]["spans"].split(",") if x.startswith("random")]
        assert set(added) <= strings and not any(a in taken or b - 1 in taken for a, b in added)


def test_running_totals(spark):
    from ledgerloom.llm.secrets import running

    rng = random.Random(9)
    lists = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 128, 4096, 4097, 9000)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    got = df.select("x", running(F.col("x"), F.lit(0), lambda a, b: a + b).alias("s"), running(F.col("x"), F.lit(-1), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r in got:
        assert r["s"] == list(np.cumsum(r["x"], dtype=int)) and r["m"] == list(np.maximum.accumulate(r["x"]) if r["x"] else [])


# Periodic texts in suffix-array dedup.


def periodic_texts():
    rng = random.Random(12)
    own = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    texts = ["a" * 99, "a" * 100, "a" * 101, "b" * 700, "", own(50) + "ab" * 120 + own(80) + "ba" * 120, "é" * 200]
    for p in (1, 2, 3, 7, 31, 32, 33, 64, 99):
        unit = own(p)
        texts += [own(rng.randrange(90)) + (unit * 400)[: rng.randrange(100, 420)] + own(rng.randrange(90)) for _ in range(3)]
    return texts + texts[3:9]


def test_self_repeats_are_those_of_a_plain_search():
    from ledgerloom.llm import suffix_dedup

    texts = [t.encode() for t in periodic_texts()]
    sizes = np.array(list(map(len, texts)))
    starts = np.cumsum(sizes) - sizes
    got = {(piece, i - starts[piece]) for piece, first, last in suffix_dedup.self_repeats(np.frombuffer(b"".join(texts), np.uint8), starts, sizes) for i in range(first, last + 1)}
    want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 99) if any(i >= p and t[i : i + 100] == t[i - p : i - p + 100] for p in range(1, 33))}
    assert got == want and len(want) > 1000


def test_periodic_texts_are_deduped_as_by_brute_force(spark):
    from ledgerloom.llm import suffix_dedup

    from .test_edge_cases import bag, brute_removed

    rows = [(i, t, "") for i, t in enumerate(periodic_texts())]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))
    assert bag(r[:5] for r in got.collect()) == bag(brute_removed(rows))


def test_twenty_megabytes_of_a_letter_and_of_a_period(spark):
    import time

    from ledgerloom.llm import suffix_dedup

    n = 20_000_000
    df = spark.range(2).selectExpr("id as doc_id", f"if(id = 0, repeat('z', {n}), repeat('1234567', {n // 7})) as text").repartition(2)
    began = time.perf_counter()
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {0: (n - 1, 1), 1: (n // 7 * 7 - 7, 1)}
    assert time.perf_counter() - began < 90


# The verdict of quality rules, document by document.


def plain_votes(measures):
    """The nine rules' votes: 1 good, 0 bad, None neither or nothing to measure."""
    from ledgerloom.llm.quality_rules import RULES

    votes = []
    for _, measure, good, bad in RULES:
        parts = [measures[x] for x in measure.split(" / ")]
        x = parts[0] if len(parts) == 1 else parts[0] / parts[1] if parts[1] else None
        votes.append(None if x is None else 1 if good[0] <= x <= good[1] else 0 if x < bad[0] or x > bad[1] else None)
    return votes


def plain_posteriors(votes, rounds=10_000):
    """Expectation-maximisation over single documents: each gets its posterior of being good, each rule its accuracies."""
    good, accuracy = 0.8, [(0.98, 0.4)] * len(votes[0])
    clip = lambda x, low, high: min(max(x, low), high)

    def posterior(own):
        odds = good / (1 - good)
        for v, (a, b) in zip(own, accuracy):
            odds *= 1 if v is None else a / (1 - b) if v else (1 - a) / b
        return odds / (1 + odds)

    for _ in range(rounds):
        p = [posterior(own) for own in votes]
        new = []
        for r in range(len(accuracy)):
            sums = {(v, c): sum((q if c else 1 - q) for q, own in zip(p, votes) if own[r] == v) for v in (0, 1) for c in (0, 1)}
            a = clip((sums[1, 1] + 1) / (sums[1, 1] + sums[0, 1] + 2), 0.6, 0.999)
            new.append((a, clip((sums[0, 0] + 1) / (sums[0, 0] + sums[1, 0] + 2), min(0.5, 2 * (1 - a)), 0.999)))
        share = clip(sum(p) / len(p), 0.02, 0.98)
        moved = max(abs(share - good), *(abs(x - y) for one, two in zip(new, accuracy) for x, y in zip(one, two)))
        good, accuracy = share, new
        if moved < 1e-6:
            break
    return [posterior(own) for own in votes]


def test_verdicts_of_quality_rules_by_plain_expectation_maximisation(spark, edge):
    from ledgerloom.llm import quality_rules

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    docs = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text").cache()
    measured = {r["doc_id"]: r.asDict() for r in quality_rules.measures(docs).collect()}
    ids = sorted(measured)
    want = dict(zip(ids, plain_posteriors([plain_votes(measured[i]) for i in ids])))
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert set(got) == set(ids) and any(r["kept"] for r in got.values())
    for i in ids:
        m = measured[i]
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        assert abs(got[i]["posterior"] - want[i]) < 1e-4 and got[i]["base_failed"] == failed
        if abs(want[i] - 0.5) > 1e-3:
            assert got[i]["kept"] == (not failed and want[i] >= 0.5)


# Word vectors, pooling and network of the quality classifier, in plain loops.


def test_vectors_pooling_and_network_by_plain_loops(spark):
    import zlib

    from ledgerloom.llm import quality_classifier as qc

    rng = random.Random(14)
    texts = [None, "", "one", *(" ".join(rng.choice(["a", "b,", "Été", "x1", "?!", "漢字", "c"]) for _ in range(rng.randrange(1, 40))) for _ in range(50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    places, signs = qc.index_vectors()
    bucket = lambda t: zlib.crc32(t.encode()) % qc.BUCKETS
    split = lambda t: [bucket(x) for x in re.findall(r"\w+|[^\w\s]+", t or "")]
    want = defaultdict(lambda: [0.0] * qc.DIMENSIONS)
    for t in texts:
        own = split(t)
        for i, a in enumerate(own):
            for b in own[max(i - 1, 0) : i] + own[i + 1 : i + 2]:
                for at, sign in zip(places[b], signs[b]):
                    want[a][at] += sign
    table = qc.word_vectors(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    length = {b: max(math.sqrt(sum(x * x for x in v)), 1e-9) for b, v in want.items()}
    for b in range(qc.BUCKETS):
        assert np.allclose(table[b], [x / length[b] for x in want[b]] if b in length else 0, atol=1e-6)
    pooled = qc.pooled([t or "" for t in texts], table, qc._Ids())
    model = {"mean": np.full(130, 0.1), "scale": np.full(130, 2.0), "a": np.random.default_rng(1).normal(size=(130, 3)), "b": np.array([0.1, -0.2, 0.3]), "c": np.array([1.0, -2.0, 0.5]), "d": np.array([0.2]), "temperature": 1.7}
    scores = qc.predict(model, pooled)
    for i, t in enumerate(texts):
        own = split(t)
        x = [0.0] * 130
        if own:
            vectors = [[y / length[b] if b in length else 0.0 for y in want.get(b, [0.0] * 64)] if b in want else [0.0] * 64 for b in own]
            for d in range(64):
                mean = sum(v[d] for v in vectors) / len(own)
                x[d], x[64 + d] = mean, math.sqrt(max(sum(v[d] ** 2 for v in vectors) / len(own) - mean**2, 0))
            x[128], x[129] = math.log(1 + len(own)), len(set(own)) / len(own)
        assert np.allclose(pooled[i], x, atol=2e-3)
        hidden = [math.tanh(sum((v - 0.1) / 2.0 * model["a"][j][k] for j, v in enumerate(pooled[i].tolist())) + model["b"][k]) for k in range(3)]
        logit = (sum(h * c for h, c in zip(hidden, model["c"])) + 0.2) / 1.7
        assert abs(scores[i] - 1 / (1 + math.exp(-logit))) < 1e-6
