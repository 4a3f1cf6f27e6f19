"""The stages one by one, and the whole."""

import random

import corpus_pipeline
import pytest

from proofsieve.llm import near_copies, simhash, toxicity
from proofsieve.llm.shared import stored


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: rng.choice(["ta", "ri", "mo", "ke", "lu", "na"]) + rng.choice(["x", "y", "z", "w", "q"]) + rng.choice("abcdefgh")
    rows = []
    for k in range(600):
        text = " ".join(word() for _ in range(rng.randint(20, 60)))
        rows.append((k, text + " idiot" * (k % 6 == 0), "en", f"s{k % 3}", len(text)))
    rows += [(1000 + k, rows[1][1], "en", "s1", 5) for k in range(5)]
    rows += [(2000, None, "en", "s0", 0), (2001, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "en", "s2", 9), (2002, "clean", None, None, None)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            kept = {r.doc_id for r in docs.collect()}
            assert not any(k % 6 == 0 for k in kept if k < 600) and len(kept) == 500 + 8
        if name == "simhash":
            groups = simhash.near_duplicates(before).collect()
            assert sorted(r.doc_id for r in docs.collect()) == sorted({r.component_id for r in groups})
        if name == "secrets":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert texts[2001] == 'x [REDACTED]" y' and {k: v for k, v in texts.items() if k != 2001} == {r.doc_id: r.text for r in before.collect() if r.doc_id != 2001}
        if name == "mixing":
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
    assert seen["bpe"].count() == seen["mixing"].count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, seen["bpe"].collect()))


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), f"empty-{name}")
        assert docs.count() == 0


def test_clean_documents_stay(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    assert toxicity.clean(docs, labels).where("doc_id >= 1000").count() == 8


def test_near_copies_are_dropped_at_four_fifths(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    line = [word() for _ in range(40)]
    rows = [(k, " ".join([word() for _ in range(rng.randint(1, 80))] + line * (k % 3 == 0))) for k in range(60)]
    for k in range(100, 114):
        base = [word() for _ in range(rng.randint(40, 200) if k < 112 else 1030)]  # the last have parities of different widths
        rows.append((10 * k, " ".join(base)))
        if k >= 112:
            rows.append((10 * k + 9, " ".join(base[: -40 - 40 * (k - 112)])))
        for copy in range(1, 8):  # words replaced in more and more places: on both sides of 0.8, few within 2 bits
            other = list(base)
            for at in rng.sample(range(len(base)), copy):
                other[at] = word().upper()
            rows.append((10 * k + copy, "  ".join(other)))
    rows += [(5000, "Two words"), (5001, "two\nWORDS"), (5002, None), (5003, ""), (None, rows[1][1]), (7, rows[7][1])]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    named = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in named}
    links = [(a, b) for a, x in named for b, y in named if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y))]
    for _ in named:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {tuple(r) for r in near_copies.near_copies(docs).collect()} == {*root.items(), (None, None)}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({*root.values()})
    assert len({*root.values()}) < len({r.component_id for r in simhash.near_duplicates(docs.where("doc_id is not null")).collect()})
    near_copies.PAIRS, before = 0, near_copies.PAIRS  # rounds against one class until these find little, then all pairs
    try:
        assert {tuple(r) for r in near_copies.near_copies(docs).collect()} == {*root.items(), (None, None)}
    finally:
        near_copies.PAIRS = before


def test_near_copies_of_a_group_are_connected_without_all_their_pairs(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for family in range(6):
        base = [word() for _ in range(220)]
        for copy in range(16):
            other = list(base)
            for at in rng.sample(range(220), rng.randint(1, 2)):
                other[at] = word()
            rows.append((100 * family + copy, " ".join(other)))
    made, candidates = [], near_copies._candidates
    monkeypatch.setattr(near_copies, "_candidates", lambda pairs, classes: made.append(pairs.count()) or candidates(pairs, classes))
    groups = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {tuple(r) for r in groups} == {(i, i // 100 * 100) for i, _ in rows}
    # All pairs at all the shingles that they share would be 100 for each text.
    assert made[0] <= len(rows) * (1 + len(near_copies.POINTS) * near_copies.HEADS) and sum(made[1:]) <= len(rows)


def test_texts_with_a_common_passage_are_not_paired_at_its_picks(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage, rows = [word() for _ in range(80)], []
    for k in range(120):
        own = [word() for _ in range(80)]
        rows.append((10 * k, " ".join(passage + own)))
        if k % 10 == 0:
            rows.append((10 * k + 1, " ".join(passage + own[:-1] + [word()])))
    made, candidates = [], near_copies._candidates
    monkeypatch.setattr(near_copies, "_candidates", lambda pairs, classes: made.append(pairs.distinct().count()) or candidates(pairs, classes))
    groups = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {tuple(r) for r in groups} == {(i, i // 10 * 10) for i, _ in rows}
    assert sum(made) <= len(rows)
