"""Corpus operators against plain versions, on the smallest tables and on rows with every odd case."""

import math
import os
import random
import sys
import zlib
from collections import defaultdict
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyward.llm import (
    chat_repair, decontaminate, license_scan, line_dedup, line_quality, links, near_dup, ordinal, packing,
    spelling, staging, substring_dedup, suffix_tree, toxicity, vector_codes,
)
from tallyward.llm import queries as corpus

from ..conftest import SMALL_TABLES
from . import brute

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
import check  # noqa: E402

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed, n, vocabulary=400):
    own = random.Random(seed)
    return " ".join(f"w{own.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, one very long text, ties, repeated rows, copies, near copies, shared passages."""
    base, shared = prose(1, 120), prose(2, 60)
    near = base.split()
    near[60] = "other"
    texts = [
        None, "", " \t\n ", "one two", "one two", base, base, " ".join(near), base.upper(), prose(3, 40) + " " + shared,
        shared + " " + prose(4, 40), prose(5, 30_000), "same same " * 30, "a\x1cb\x85c d e f g", "line one is here now\n" * 4,
        prose(6, 30) + "\n" + prose(7, 30) + "\n" + prose(8, 12), prose(9, 9) + ".\n" + prose(7, 30) + "\n" + prose(8, 12),
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows, [*rows, rows[5], rows[3], (None, base), (None, None)]


CLASHES = ["node", "sig", "value", "doc", "lead", "block", "word", "line", "lines", "gone", "words", "n", "key", "head", "n_words"]


@pytest.fixture(scope="module")
def odd(spark):
    unique, rows = odd_rows()
    df = spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], ["doc_id", "text", *CLASHES])
    df = df.withColumn("doc_id", F.col("doc_id").cast("long")).cache()
    return df, dict(unique), rows


@pytest.fixture(scope="module")
def small(spark):
    df = spark.read.parquet(f"{SMALL_TABLES}/documents.parquet")
    return df, {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL_TABLES)


def empty_of(df):
    return df.where("1 = 0")


@pytest.mark.parametrize("tables", ["odd", "small"])
def test_near_duplicates(request, tables):
    df, texts, *_ = request.getfixturevalue(tables)
    expected = brute.near_groups(texts, 85)
    got = near_dup.near_duplicates(df, 85).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_near_duplicates_in_tiles(spark, monkeypatch):
    """A large group of near copies of which few are linked, in many tiles, gives the same groups as all pairs."""
    monkeypatch.setattr(near_dup, "TILE", 8)
    own, base = random.Random(5), prose(11, 90).split()
    texts = {}
    for i in range(70):
        w = list(base)
        for k in own.sample(range(90), own.choice([1, 2, 3])):
            w[k] = f"x{own.randrange(10_000)}"
        texts[i] = " ".join(w)
    got = near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.near_groups(texts, 85)
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 85).count() == 0


def test_components(spark):
    own = random.Random(1)
    pairs = [(own.randrange(300), own.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    got = links.components(spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")).collect()
    expected = brute.components({x for p in pairs for x in p}, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.label for r in got} == {x: expected[x] for x in linked}


@pytest.mark.parametrize("tables", ["odd", "small"])
def test_repeated_spans(request, tables):
    df, texts, *_ = request.getfixturevalue(tables)
    expected = brute.without_repeats(texts, 20)
    got = substring_dedup.repeated_spans(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert sum(f.length for f in r.factors) == r.n_removed
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == expected[r.doc_id]
        else:
            assert r.n_removed == 0


def test_factor_goes_on_over_a_boundary():
    windows = np.array([1, 2, 3, 4, 5, 6], np.uint64)
    assert substring_dedup.parse(windows, {1: 7, 2: 7, 3: 8}, 9, 4) == [(0, 5, 7), (5, 1, 8)]
    assert substring_dedup.parse(np.array([1, 1], np.uint64), {}, 9, 4) == [(1, 4, 9)]


@pytest.mark.parametrize("tables", ["odd", "small"])
def test_packing_round_trip(request, tables):
    df, _, *rest = request.getfixturevalue(tables)
    rows = rest[0] if rest else [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = packing.pack(df, VOCABULARY).collect()
    full, places, pieces = Tokenizer.from_file(VOCABULARY), defaultdict(list), defaultdict(int)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    for doc, text in rows:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (start, n) in enumerate(packing.cuts(len(ids), 1024)):
            pieces[doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] -= 1
    assert not any(pieces.values())
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024


def test_packing_solutions():
    """Every piece has a place; the reduction never costs a sequence against an exhaustive search."""
    own = np.random.default_rng(2)

    def exact(items, capacity):
        best = [len(items)]

        def go(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for j in {r: n for n, r in enumerate(rooms) if r >= items[k]}.values():
                go(k + 1, [r - items[k] if n == j else r for n, r in enumerate(rooms)])
            go(k + 1, [*rooms, capacity - items[k]])

        go(0, [])
        return best[0]

    for _ in range(60):
        capacity = int(own.integers(6, 30))
        items = sorted(own.integers(1, capacity + 1, int(own.integers(1, 9))).tolist(), reverse=True)
        counts = np.bincount(items, minlength=capacity + 1)
        left = counts.copy()
        fixed = packing.reduce_counts(left, capacity)
        rest = [x for x in range(capacity, 0, -1) for _ in range(int(left[x]))]
        assert sum(n for _, n in fixed) + exact(rest, capacity) == exact(items, capacity)
        held = np.zeros_like(counts)
        for lengths, times in packing.solve(counts, capacity):
            assert sum(lengths) <= capacity
            for x in lengths:
                held[x] += times
        assert (held == counts).all()


def test_fast_encoder_agrees():
    full, fast = Tokenizer.from_file(VOCABULARY), packing.encoder(VOCABULARY)
    for text in ["", "a  b\n\n c", "<|endoftext|> x", "Éè’s ’ll 12 3,4 été x", "don't I'LL", "\x85 x", "中文 text", "\x1c\x1d a"]:
        assert fast(text) == full.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", list(corpus.ORACLE))
def test_agrees_with_sql(spark, con, name):
    verdict = check.compare(corpus.QUERIES[name](spark, SMALL_TABLES), con, corpus.ORACLE[name])
    assert verdict.startswith("ok"), verdict


def test_line_quality_odd(odd):
    df, texts, rows = odd
    got = line_quality.judged(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in texts.items():
        assert by_id[i].n_words == len(brute.words(t))
    assert not by_id[0].kept and by_id[0].cleaned_text == "" and by_id[12].base_failed
    menu = "Home | About | News | Shop | Help\n" + prose(60, 70) + "."
    cleaned = line_quality.judged(df.limit(1).select("doc_id", F.lit(menu).alias("text"))).first()
    assert cleaned.kept and cleaned.lost_words == 9 and not cleaned.cleaned_text.startswith("Home")
    assert line_quality.judged(empty_of(df)).count() == 0


def test_license_scan(spark, odd):
    gpl = license_scan.TEMPLATES["GPL-3.0"][1].split()
    gpl[20] = "changed"
    rows = [
        (1, prose(1, 300) + " " + " ".join(gpl) + " " + prose(2, 50)), (2, "x\nReleased under the MIT License.\ny"),
        (3, "all RIGHTS, reserved!"), (4, " ".join(gpl[:15])), (None, "Licensed under CC BY-NC 4.0."), (6, prose(4, 20_000)), (7, None),
    ]
    got = license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license_id, r.n_matches) for r in got} == {
        (1, "GPL-3.0", 1), (2, "MIT", 1), (3, "All-rights-reserved", 1), (None, "CC-BY-NC-4.0", 1)
    }
    assert license_scan.licenses(odd[0]).count() == 0


def test_license_scan_misses_no_edit_and_no_begin(spark):
    """Every template with a word replaced, at every place and in several alignments, is found if enough shingles are left;
    also where the text begins inside the notice or lacks an early word, in the first row and in the second."""
    rows, expected = [(0, "some other text of more than a few words")], set()
    for name, templates in license_scan.TEMPLATES.items():
        for template in templates:
            w = "".join(c if c.isalnum() else " " for c in template.lower()).split()
            grams = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
            edits = [[*w[:k], "zzz", *w[k + 1 :]] for k in range(len(w))] + [w[1:], w[2:], w[3:], [w[0], *w[2:]]]
            for k, edit in enumerate(edits):
                left = {tuple(edit[j : j + 5]) for j in range(max(len(edit) - 4, 1))}
                for ahead in [0] if k >= len(w) else [0, 3, 7]:
                    if 100 * len(grams & left) >= 80 * len(grams):
                        expected.add((len(rows), name))
                    rows.append((len(rows), " ".join([*(f"p{j}" for j in range(ahead)), *edit, "q1 q2 q3"])))
    for own in (rows, rows[::-1]):
        got = license_scan.licenses(spark.createDataFrame(own, "doc_id long, text string").coalesce(1)).collect()
        assert {(r.doc_id, r.license_id) for r in got} == expected and all(r.n_matches == 1 for r in got)


def _shuffled_notices(seed, count):
    """Texts of one notice each with cut, moved, repeated, replaced and added words, and its own words anywhere."""
    own = random.Random(seed)
    every = [t for texts in license_scan.TEMPLATES.values() for t in texts]
    rows = []
    for i in range(count):
        w = own.choice(every).split()
        for _ in range(own.randrange(4)):
            k, n = own.randrange(len(w)), own.randrange(1, 9)
            kind = own.randrange(4)
            if kind == 0 and len(w) > n:
                del w[k : k + n]
            elif kind == 1:
                w[k:k] = w[max(0, k - n) : k]
            elif kind == 2:
                w[k:k] = [f"x{own.random()}"] * n
            else:
                cut = w[k:]
                w = cut + w[:k]
        lead = [f"p{j}" for j in range(own.randrange(9))]
        rows.append((i, " ".join([*lead, *w, *own.choice(every).split()[: own.randrange(12)]])))
    return rows


def test_license_scan_agrees_with_laying_templates_everywhere(spark, odd):
    repeating = {"again": ["one two three four five one two three four six one two three four seven one two one two one two"]}
    rows = _shuffled_notices(5, 1500) + [(i, t) for i, t in odd[1].items()]
    own = random.Random(3)
    rows += [(10_000 + i, " ".join(own.choices(["one", "two", "three", "four", "five", "six"], k=40))) for i in range(50)]
    base = repeating["again"][0].split()
    for i in range(300):
        cuts = [own.randrange(len(base)) for _ in range(own.randrange(1, 4))]
        rows.append((20_000 + i, " ".join(x for k in cuts for x in base[k : k + own.randrange(5, 20)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for templates, percent in ((license_scan.TEMPLATES, 80), (license_scan.TEMPLATES, 60), (repeating, 50)):
        got = {tuple(r) for r in license_scan.licenses(df, templates, percent).collect()}
        assert got == set(brute.licenses(rows, templates, percent)) and len(got) > 20


def test_license_windows_fit_in_every_intact_run():
    index = license_scan.Index(license_scan.TEMPLATES, 80)
    for _, width, step in index.classes:
        assert 1 <= step <= width + 1 and width <= 8


def test_license_scan_finds_every_notice(small):
    df, texts = small
    got = {(r.doc_id, r.license_id) for r in license_scan.licenses(df).collect()}
    notices = {"MIT": "Released under the MIT License", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
               "Apache-2.0": license_scan.TEMPLATES["Apache-2.0"][0], "GPL-3.0": license_scan.TEMPLATES["GPL-3.0"][0],
               "All-rights-reserved": "All rights reserved"}
    assert got == {(i, name) for i, t in texts.items() for name, notice in notices.items() if notice in (t or "")}


def test_ordinal_model_on_held_out_documents(spark):
    rows, ratings = [], []
    for i in range(900):
        own, kind = random.Random(i), i % 3
        w = prose(i, 80).split()
        if kind == 1:
            w[own.randrange(80)] = own.choice(["vile", "nasty", "vileness"])
        if kind == 0:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        ratings.append((i, int(kind > 0), int(kind == 1)))
    ratings += [(5, None, 0), (None, 1, 0), (3, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(ratings, "doc_id long, quality int, toxic int")
    model = ordinal.train(docs, labels.where("doc_id < 600 or doc_id is null"))
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in ordinal.graded(docs, model).collect()}
    held = range(600, 900)
    assert np.mean([got[i].kept == (i % 3 == 2) for i in held]) > 0.97
    means = [np.mean([got[i].expected_grade for i in held if i % 3 == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]


def test_ordinal_model_takes_common_and_rare_words(spark):
    """A word of a bad source that holds a third of the rows, and a toxic word in 0.2 % of them."""
    rows, ratings, kinds = [], [], {}
    for i in range(4500):
        own, w = random.Random(i), prose(i, 60).split()
        kinds[i] = "source" if i % 3 == 0 else "rare" if i % 500 in (1, 251) and i < 3000 or i >= 3000 and i % 50 == 1 else (
            "toxic" if i % 40 == 2 else "good")
        mark = {"source": "brandmark", "rare": "vile", "toxic": "nasty"}.get(kinds[i])
        if mark:
            w[own.randrange(60)] = mark
        rows.append((i, " ".join(w)))
        ratings.append((i, int(kinds[i] != "source"), int(kinds[i] in ("rare", "toxic"))))
    assert 4 <= sum(kinds[i] == "rare" for i in range(3000)) <= 9
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4)
    labels = spark.createDataFrame(ratings, "doc_id long, quality int, toxic int").where("doc_id < 3000").coalesce(4)
    got = {r.doc_id: r.kept for r in ordinal.graded(docs, ordinal.train(docs, labels)).collect()}
    kept = {k: np.mean([got[i] for i in range(3000, 4500) if kinds[i] == k]) for k in ("source", "rare", "toxic", "good")}
    assert kept["source"] < 0.02 and kept["rare"] < 0.05 and kept["toxic"] < 0.05 and kept["good"] > 0.97, kept


def test_ordinal_odd(odd):
    df, _, rows = odd
    labels = df.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert ordinal.graded(df, ordinal.train(df, labels)).count() == len(rows)
    assert ordinal.train(df, empty_of(labels)) is None
    assert ordinal.graded(df, None).where("kept").count() == len(rows)


@pytest.mark.parametrize("tables", ["odd", "small"])
def test_line_dedup(request, tables):
    df, texts, *_ = request.getfixturevalue(tables)
    expected = brute.lines_left(texts, line_dedup.BLOCK_WORDS)
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.text or "") == expected[r.doc_id]


def lines_left(spark, texts):
    got = line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    return {r.doc_id: r.text for r in got}


def test_line_dedup_of_popular_lines(spark):
    """A block of two lines goes however many documents hold each of them, in whatever order or number the first does."""
    x, y = "x1 x2 x3 x4 x5", "y1 y2 y3 y4 y5"
    for n in (4, 6, 9):
        left = lines_left(spark, {1: x, 2: y} | {i: f"{x}\n{y}\nown {i}" for i in range(3, n + 1)})
        assert left == {1: x, 2: y, 3: f"{x}\n{y}\nown 3"} | {i: f"own {i}" for i in range(4, n + 1)}
    left = lines_left(spark, {1: f"{y}\n{x}\n{x}"} | {i: f"{x}\n{y}\nown {i}" for i in range(2, 8)})
    assert left[2] == f"{x}\n{y}\nown 2" and all(left[i] == f"own {i}" for i in range(3, 8))


def test_line_dedup_covers_every_pair(spark, monkeypatch):
    """The same as aligning every document with every earlier one, in rounds whose number grows with the log of the holders."""
    calls = []
    aligned = line_dedup._aligned
    monkeypatch.setattr(line_dedup, "_aligned", lambda pairs, listed: calls.append(1) or aligned(pairs, listed))
    own = random.Random(8)
    pool = ["", *(prose(100 + k, own.choice([1, 2, 3, 5, 9])) for k in range(14))]
    texts = {i: "\n".join(own.choice(pool) for _ in range(own.randrange(1, 14))) for i in range(60)}
    texts |= {i: texts[i % 7] for i in range(60, 75)}
    assert lines_left(spark, texts) == brute.lines_left(texts, line_dedup.BLOCK_WORDS)
    assert 2 <= len(calls) <= 8


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert line_dedup.patience([5, 5, 1, 6], [5, 1, 5, 6]) == [(0, 0), (2, 1), (3, 3)]
    assert line_dedup.common_lines([1, 2, 3], [7, 2, 3, 1], [1, 5, 5, 5], 8) == [1, 2]


def test_masks_cover_every_two_replacements():
    for gone in combinations(range(decontaminate.WINDOW), decontaminate.REPLACED):
        assert any(
            not {p + k for k in mask} & set(gone)
            for mask in decontaminate.MASKS for p in range(decontaminate.WINDOW - mask[-1])
        )


def test_overlaps(spark, odd):
    item = prose(50, 30)
    w = item.split()
    w[4], w[11] = "x", "y"
    items = spark.createDataFrame([(1, item), (2, "short item of six words here"), (3, None), (None, item), (5, "")], "item_id long, text string")
    rows = [
        (1, prose(51, 40) + " " + " ".join(w[:13]) + " " + prose(52, 40)), (2, " ".join(w[:10]) + " " + prose(53, 9)),
        (3, "A short, item of SIX words here!"), (4, "a short item of seven words here"), (None, item), (6, item), (6, None), (7, None),
    ]
    got = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id, r.matched, r.first_token) for r in got} == {(1, 1, 11, 40), (3, 2, 6, 1), (6, 1, 13, 0)}
    assert decontaminate.overlaps(odd[0], items).count() == 0
    assert decontaminate.overlaps(odd[0], empty_of(items)).count() == 0


@pytest.mark.parametrize("tables", ["odd", "small"])
def test_suffix_tree_scores(request, tables):
    df, texts, *rest = request.getfixturevalue(tables)
    rows = rest[0] if rest else list(texts.items())

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1

    counts = brute.training_counts(dict(enumerate(t for _, t in rows)), lambda k: held(rows[k][0]))
    total, kinds = sum(counts.values()), len(counts)
    expected = defaultdict(list)
    for i, t in rows:
        tokens = brute.words(t, lower=True) + [None]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in tokens)
        expected[i].append((held(i), len(tokens), sum(counts[x] > 0 for x in tokens), total, base))
    got = suffix_tree.suffix_tree_scores(df).collect()
    assert len(got) == len(rows)
    for r in got:
        options = expected[r.doc_id]
        assert any(
            (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == o[:4] and math.isclose(r.base_score, o[4], rel_tol=1e-9)
            for o in options
        ) and r.score < 0
    if tables == "small":
        apart = [r for r in got if r.held_out]
        assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def test_suffix_tree_scores_equal_a_plain_tree(request, spark, monkeypatch):
    """Also over many blocks and ranges, with copies, and with texts that begin or end in the same words."""
    small = request.getfixturevalue("small")[1]
    shared = [(1000 + k, f"once upon a time {prose(k % 5, 20, 30)} the end") for k in range(60)]
    rows = [*small.items(), *shared, *[(2000, "a b a b a b a b")] * 4, (None, None), (3000, ""), (3001, None)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    plain = brute.suffix_tree(rows, held)
    expected = sorted((-1 if i is None else i, *x) for (i, _), x in zip(rows, plain, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (12 << 20, 20_000):
        monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", size)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.base_score, r.score) for r in suffix_tree.suffix_tree_scores(df).collect())
        assert [r[0] for r in got] == [r[0] for r in expected]
        assert np.allclose([r[1:] for r in got], [r[1:] for r in expected], rtol=1e-9)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stage_")]


def test_distinct_hashes():
    """Also where hashes differ in their last bits only."""
    own = np.random.default_rng(3)
    for values in (own.integers(0, 1 << 63, 500, dtype=np.uint64), own.integers(0, 300, 500, dtype=np.uint64) + np.uint64(1 << 40), np.empty(0, np.uint64)):
        for got, expected in zip(suffix_tree._distinct(values), np.unique(values, return_index=True, return_inverse=True), strict=True):
            assert (got == expected).all()


def test_suffix_tree_texts_move_once(spark):
    """Grouping the dealt texts by block needs no exchange."""
    with staging.shelf(spark) as own:
        texts = own.deal(spark.createDataFrame([(1, "a")], "block long, text string"), "texts", "block", 3)
        plan = texts.groupBy("block").applyInArrow(lambda t: t, texts.schema)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_suffix_tree_packs_numbers():
    """Also none, equal ones and several a row; random low bytes do not spoil the code of the high ones."""
    own = np.random.default_rng(4)
    for values in (np.empty((0, 2), np.int64), np.zeros(9, np.uint32), own.integers(0, 1 << 40, (700, 3)), own.integers(0, 5, 3000).astype(np.uint64)):
        packed = suffix_tree._packed(values)
        assert (suffix_tree._unpacked(packed, len(values), values.dtype.type, *values.shape[1:]) == values).all()
    mask = own.random(1001) < 0.1
    assert (suffix_tree._unpacked_bits(suffix_tree._packed_bits(mask), 1001) == mask).all()
    # The differences of 10,000 sorted hashes out of 64 bits / 128 hold 45.2 bits each.
    steps = np.diff(np.sort(own.integers(0, 1 << 57, 10_000, dtype=np.uint64)))
    assert len(suffix_tree._packed(steps)) < 5.75 * len(steps)


def test_suffix_tree_moves_no_hash_of_a_context():
    """What blocks send to test contexts, and read to list longer runs, takes few bytes for each."""
    blocks, answers, sent, read = [], [[], []], [], []
    for k in range(2):
        texts = [f"{prose(k * 100 + i, 200, 40)} ." for i in range(60)]
        blocks.append(pa.table({"doc_id": range(60), "text": texts, "held_out": [i % 5 == 1 for i in range(60)], "block": [k] * 60}))
    for level in range(4):
        rows = []
        for k, block in enumerate(blocks):
            own = suffix_tree.Block(block, 3)
            if level:
                seen = pa.concat_tables(answers[k]).select(suffix_tree.GROWING)
                read.append(sum(len(x.as_py() or b"") for c in seen.columns if pa.types.is_binary(c.type) for x in c) / sum(seen["size"].to_pylist()))
                own = own.take(seen, level - 1).grow()
            rows.append(own.ask(level, 0))
        found = suffix_tree._counter(3, level == 3)(pa.concat_tables(rows))
        for k in range(2):
            answers[k].append(found.filter(pc.equal(found["block"], k)))
    for k, block in enumerate(blocks):
        asked = suffix_tree.Block(block, 3).take(pa.concat_tables(answers[k]).select(suffix_tree.TESTING), 3).test(3, 24_000, 0)
        sent.append(sum(len(r["keys"]) + len(r["figures"]) + len(r["runs"]) for r in asked.to_pylist()) / sum(asked["size"].to_pylist()))
    assert max(read) < 0.25 and max(sent) < 6


def test_suffix_tree_keeps_a_phrase_in_a_larger_corpus(spark):
    """A rare phrase is learned however much other text there is."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    phrase = "quartz umbrella gazelle fjord"
    rows = [(i, prose(i, 300, 30) + (f" {phrase} " if k < 6 else " ") + prose(i + 1000, 300, 30)) for k, i in enumerate(ids)]
    asked = next(i for i in range(400, 500) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([*rows, (asked, phrase)], "doc_id long, text string")
    r = suffix_tree.suffix_tree_scores(df).where(F.col("doc_id") == asked).first()
    # Three of the five tokens follow their predecessor in every one of six occurrences among 190,000 tokens.
    assert r.score - r.base_score > 9


def best_cost(roles, costs):
    best = []

    def go(k, state, cost):
        if k == len(roles):
            best.append(cost + costs.insert * len(chat_repair.ENDS[state]))
            return
        for new in chat_repair.ROLES:
            extra = 0 if new == roles[k] else costs.relabel
            if (state, new) in chat_repair.GAPS:
                go(k + 1, new, cost + extra + costs.insert * len(chat_repair.GAPS[state, new]))
            if state == new:
                go(k + 1, new, cost + extra + costs.merge)

    go(0, chat_repair.START, 0)
    return min(best)


def test_chat_repair_is_cheapest():
    own, costs = random.Random(4), chat_repair.Costs()
    for _ in range(120):
        roles = [own.choice(["user", "assistant", "system", "tool", None]) for _ in range(own.randrange(1, 7))]
        reached, _ = chat_repair.best_paths(roles, {chat_repair.START: 0}, costs)
        end = chat_repair.best_end(reached, costs)
        assert reached[end] + costs.insert * len(chat_repair.ENDS[end]) == best_cost(roles, costs)


def test_chat_repair_over_tasks(spark):
    own, rows = random.Random(3), []
    for conv in range(30):
        for t in range(own.choice([1, 2, 3, 5]) if conv else 60):
            role = own.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            rows.append((conv if conv != 7 else None, own.choice([t, t // 2]), role, own.choice([f"t{t}", "same", None, ""])))
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, part string, at string")
    whole, cut = (chat_repair.repair(df, task_turns=n).collect() for n in (10_000, 7))
    assert sorted(map(repr, whole)) == sorted(map(repr, cut))
    assert sum(r.copies for r in whole) == len(rows) and len(whole) == len(set(rows))
    rendered = defaultdict(list)
    for r in whole:
        rendered[r.conv_id].append(r)
    for own_rows in rendered.values():
        text = "".join(r.rendered for r in sorted(own_rows, key=lambda r: (r.turn, r.role or "", r.out_turn)))
        assert text.endswith(chat_repair.CLOSED) and text.count("<|end|>") == text.count("<|system|>") + text.count("<|user|>") + text.count("<|assistant|>")
    assert chat_repair.repair(empty_of(df)).count() == 0


def test_operators_take_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n string")
    for made in (
        substring_dedup.repeated_spans(none), packing.pack(none, VOCABULARY), license_scan.licenses(none),
        line_dedup.dedup_lines(none), suffix_tree.suffix_tree_scores(none), spelling.spelling_variants(none),
        vector_codes.encode(vectors_of(spark, [])), vector_codes.encode(vectors_of(spark, [(1, None, 1)])),
    ):
        assert made.count() == 0


def variants_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df).collect()}


def test_spelling_variants_odd(odd):
    df, _, rows = odd
    assert variants_of(df) == brute.spelling(rows)


@pytest.mark.parametrize("block_rows", [1024, 3])
def test_spelling_variants_of_dense_families(spark, monkeypatch, block_rows):
    """Short words over a small alphabet: edits at every place, runs of one letter, chains of forms, ties; blocks cut down to one code point."""
    monkeypatch.setattr(spelling, "BLOCK_ROWS", block_rows)
    own = random.Random(4)
    listed = ["".join(own.choice("aéb") for _ in range(own.randrange(4, 9))) for _ in range(400)] + ["a" * k for k in range(4, 90)]
    rows = [(k, " ".join(own.choice(listed) for _ in range(60)) + " " + " ".join(["aaaaa"] * (k % 3) + [f"x{own.choice(listed)}-" * 4])) for k in range(150)]
    rows += [(900, "Ab×÷ÿÀà " * 4), (None, "strasse Strasse STRASSE straße " * 2), (901, ("ß" * 200 + " ") * 5 + ("ß" * 199 + "a ") * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.spelling(rows)
    assert any(len(x[1]) != len(w) for w, x in expected.items()) and len(expected) > 300
    assert variants_of(df) == expected


def test_every_pair_of_near_words_is_found_once(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_ROWS", 2)
    listed = ["".join(x) for x in product("ab", repeat=6)] + ["".join(x) for x in product("ab", repeat=7)]
    df = spark.createDataFrame([(w, 3) for w in listed], "word string, n long")
    with staging.shelf(spark) as shelf:
        got = {r.word: r.n_near for r in spelling.near_words(df, shelf).collect()}
    assert got == {w: sum(brute._one_edit(w, v) for v in listed if v != w) for w in listed}


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, far string, parts string")


def test_vector_codes(spark):
    """Ties, repeated vectors, unusable ones, null labels, more and fewer rows than entries."""
    own = np.random.default_rng(8)
    base = np.round(own.normal(size=(40, 8)), 1).astype(np.float32)
    rows = [(k, [float(x) for x in base[own.integers(40)] + (own.normal(size=8) * (k % 3) / 4).astype(np.float32)], [None, 1, 2][k % 3]) for k in range(420)]
    bad = [(1000, None, 1), (1001, [1.0] * 7 + [None], 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] + [0.0] * 7, 2), (1004, [], 1), (1005, [1.0] * 6, 1)]
    rows32 = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows]
    got = vector_codes.encode(vectors_of(spark, rows + bad)).drop("label").collect()
    assert sorted(tuple(r) for r in got) == brute.vector_codes(rows32)
    few = vector_codes.encode(vectors_of(spark, rows[:30])).drop("label").collect()
    assert sorted(tuple(r) for r in few) == brute.vector_codes(rows32[:30])
    odd_ids = vector_codes.encode(vectors_of(spark, [*rows[:30], (None, rows[3][1], 1), rows[0], (7000, [1e30] * 8, None)])).collect()
    assert len(odd_ids) == 33 and sum(r.vec_id is None for r in odd_ids) == 1


def test_pivots_find_the_nearest_entry():
    own = np.random.default_rng(2)
    for scale in (3, 300, 1 << 20):
        rows, entries = own.integers(-scale, scale, (300, 4)), own.integers(-scale, scale, (50, 4))
        rows[:20] = entries[:20]
        pivots = vector_codes.spread(entries, 6)
        index, exact, n = vector_codes.nearest(rows, vector_codes.distances(rows, pivots).astype(np.float32).astype(float), entries, pivots)
        far = ((rows[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        assert (index == far.argmin(axis=1)).all() and (exact == far.min(axis=1)).all() and n <= far.size
        assert scale == 3 or n < 0.8 * far.size


INSULTS = ["blargh", "snurfel", "vermick"]


def rated_texts(n, seed):
    """One document in ten is toxic: it holds insults, some after signs or with digits for letters; half the others hold digits and capitals."""
    own, rows = random.Random(seed), []
    for k in range(n):
        w = prose(seed * 100_000 + k, own.randrange(60, 300)).split()
        toxic = int(k % 10 == 0)
        for _ in range(own.randrange(3, 9) * toxic):
            w[own.randrange(len(w))] = own.choice(INSULTS) + own.choice(["", "s", "er", "!", ","])
        if k % 2:
            w[0], w[-1] = "CAPITALS", "4ever!!"
        rows.append((k, " ".join(w), toxic))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = rated_texts(3000, 3)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == (got[i].score >= 0.7) for i, _, _ in rows)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p for p, y in held if y) >= 0.95 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.01 * len(held)
    # Ratings of the held-out third change nothing, nor does how rows are dealt.
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.scored(docs.repartition(7), toxicity.train(docs.repartition(5), flipped.repartition(3)))
    assert {r.doc_id: round(r.score, 9) for r in again.collect()} == {i: round(r.score, 9) for i, r in got.items()}
    # Insults written with digits are found by reading them as letters.
    hidden = " ".join([*prose(5, 100).split(), *["bl4rgh", "snurf3l", "v3rmick", "bl4rgh!"] * 2])
    assert toxicity.scored(spark.createDataFrame([(1, hidden)], "doc_id long, text string"), model).first().predicted == 1


def test_toxicity_odd(odd):
    df, _, rows = odd
    labels = df.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") == 4, None).otherwise(0).alias("toxic"), F.lit(1).alias("n")).union(df.select("doc_id", F.lit(0), F.lit(2)).limit(3))
    for rated in (labels, empty_of(labels), labels.where("toxic = 1"), labels.where("toxic = 0")):
        got = toxicity.scored(df, toxicity.train(df, rated)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert toxicity.scored(empty_of(df), toxicity.train(empty_of(df), labels)).count() == 0


def test_isotonic_pools_violators():
    at, share = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1]))
    assert share.tolist() == [0, 0.5, 1] and at.tolist() == [1, 3.25, 5]


def test_trees_follow_the_gradient():
    """The first cut of a tree is the best of all cuts, tried one by one."""
    own = np.random.default_rng(1)
    binned, toxic = own.integers(0, 8, (400, 3)), np.zeros(400)
    toxic[(binned[:, 1] > 4) ^ (own.random(400) < 0.1)] = 1
    slope, curve = toxic - 0.5, np.full(400, 0.25)
    tree = toxicity.grow(binned, slope, curve)

    def gain(k, b):
        left = binned[:, k] <= b
        return sum(slope[x].sum() ** 2 / (curve[x].sum() + 1) for x in (left, ~left))

    assert (tree.feature[0], tree.limit[0]) == max(((k, b) for k in range(3) for b in range(7)), key=lambda x: gain(*x))
    start, trees = toxicity.boost(binned, toxic)
    assert ((toxicity.margins(start, trees, binned) > 0) == toxic).mean() > 0.88
