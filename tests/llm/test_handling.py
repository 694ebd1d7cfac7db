"""Missing and repeated ids, names in another case, bounds per language, last bits of distances, the composed grammar."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from repoquarry.llm import languages, near_dedup, nearest, sentence_pieces, toxicity
from repoquarry.llm.queries import PIECE_MODEL


def test_one_row_of_near_copies_without_ids_stays(spark):
    def text(g, change=None):
        words = [f"g{g}w{k}" for k in range(60)]
        if change is not None:
            words[change] = "changed"
        return " ".join(words)

    rows = [(None, text(1), "a"), (None, text(1, 3), "b"), (None, text(1), "c"), (None, text(2), "d"), (7, text(2, 5), "e"), (9, text(2), "f"), (None, text(3), "g"), (None, None, "h"), (None, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _key string").repartition(3)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sum(r._key in "abc" for r in found) == 1
    assert sorted(r._key for r in found if r._key not in "abc") == ["e", "g", "h", "i"]


def test_columns_named_alike_in_another_case(spark):
    docs = spark.createDataFrame([(1, "some words", "old", "old")], "doc_id bigint, text string, SCORE string, Ids string")
    scored = toxicity.score_toxicity(docs, toxicity.Model({}, toxicity.PRIOR), score="score")
    assert scored.columns == ["doc_id", "text", "Ids", "score"] and 0 <= scored.first().score <= 1
    assert sentence_pieces.encode_pieces(docs, PIECE_MODEL, ids="ids").columns == ["doc_id", "text", "SCORE", "ids"]
    tagged = languages.tag_languages(docs.withColumnRenamed("SCORE", "Lang_Pred"), languages.Model([], {}, np.zeros((1, 0)), {}), with_spans=False)
    assert tagged.columns == ["doc_id", "text", "Ids", "lang_pred", "lang_score"]


def test_rare_language_is_learned(spark):
    draw = random.Random(7)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "rr": ["sch", "ein", "pf", "ung"]}
    text = lambda lang: " ".join("".join(draw.choice(syllables[lang]) for _ in range(3)) for _ in range(20))
    rows = [(i, text("aa"), "aa") for i in range(2_000)] + [(5_000 + i, text("rr"), "rr") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = languages.learn(docs, most_docs=40, most_trigrams=30)
    assert model.languages == ["aa", "rr"]
    found = languages.tag_languages(docs.filter("doc_id >= 5000"), model, with_spans=False).collect()
    assert {r.lang_pred for r in found} == {"rr"}
    everything = languages.learn(docs, most_docs=None, most_trigrams=None)
    assert len(everything.trigrams) >= len(model.trigrams)


def test_no_neighbour_is_lost_by_the_last_bit(monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 4)
    draw = np.random.default_rng(3)
    line = draw.normal(size=16)
    for scale in (1e-3, 1.0, 1e5):
        points = np.outer(draw.integers(0, 200, 240) * scale / 7, line)
        ids = np.arange(len(points))
        near, who = nearest.Tree(points, ids).search(points, ids, 5, 1.0)
        far = nearest.distances(points, points)
        far[ids, ids] = np.inf
        for q in ids:
            want = np.lexsort((ids, far[q]))[:5]
            assert who[q].tolist() == want.tolist() and near[q].tolist() == far[q][want].tolist()


def test_rows_of_one_id_count_with_their_smallest_vector(spark):
    rows = [(1, [5.0, 5.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [4.0, 5.0]), (1, [3.0, 3.0]), (4, [0.5, 9.0])]
    results = set()
    for turn in range(3):
        part = spark.createDataFrame(rows[turn:] + rows[:turn], "vec_id bigint, embedding array<double>").coalesce(1)
        results.add(tuple(sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest.nearest(part, F.col("vec_id") > 0, k=3).collect())))
    (only,) = results
    assert (2, 1, 1, 1.0) in only


def test_composed_machine_does_what_its_parts_do():
    draw = random.Random(5)
    moves, kinds = toxicity.compose(toxicity.GRAMMAR)
    for _ in range(300):
        clause = [draw.randrange(toxicity.INTENT + 1) for _ in range(draw.randrange(30))]
        state, single = 0, dict.fromkeys(toxicity.GRAMMAR, 0)
        for symbol in clause:
            marks = set()
            for name, machine in toxicity.GRAMMAR.items():
                single[name], on = machine.step(single[name], symbol)
                if on:
                    marks.add(name)
            want = -1
            if symbol == toxicity.INSULT:
                want = toxicity.KINDS.index(next((f"{m} insult" for m in ("negated", "reported", "aimed") if m in marks), "insult"))
            elif symbol == toxicity.THREAT and not marks & {"negated", "reported"}:
                want = toxicity.KINDS.index("meant threat" if "meant" in marks else "threat")
            assert kinds[state][symbol] == want
            state = moves[state][symbol]
