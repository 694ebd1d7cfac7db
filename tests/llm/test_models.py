from __future__ import annotations

import ast
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repoquarry.llm import languages, nearest, queries, toxicity

from .conftest import ODD, one_row


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(1)
    words = [f"{a}{b}" for a in ("ar", "bel", "cor", "dun") for b in ("el", "im", "ot", "us", "an")]
    rows, labels = [], []
    for i in range(600):
        own = [draw.choice(words) for _ in range(draw.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            own[draw.randrange(len(own))] = draw.choice(["grobal", "grobin", "grobus"]) + draw.choice(["", "."])
        rows.append((i, " ".join(own), "xx"))
        labels.append((i, int(toxic) if i % 10 else None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_finds_held_out_labels(labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels)
    assert any(p.startswith("grob") for p in model.patterns) and len(model.patterns) <= 8
    rows = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in rows if is_held_out(i)]
    assert len(held) > 100
    assert [rows[i] >= 0.3 for i in held] == [i % 6 == 0 for i in held]


def test_toxicity_of_odd_documents(spark, labelled, odd, empty):
    docs, labels = labelled
    model = toxicity.learn(docs, labels)
    rows = toxicity.score_toxicity(odd, model, score="h").collect()
    assert len(rows) == len(ODD) and all(0 <= r.h < 0.3 and r["class"] == "kept" for r in rows)
    assert toxicity.score_toxicity(empty, model).collect() == []
    assert toxicity.learn(docs, labels.filter("false")).patterns == {}
    assert toxicity.learn(empty, labels.limit(0)).patterns == {}


def test_clauses_decide():
    scorer = toxicity.Scorer({"grob": 5.0})
    kinds = {
        "a grobal thing": "insult",
        "you are a grobal": "aimed insult",
        "this is not grobal": "negated insult",
        "the man said it is grobal": "reported insult",
        "the man said so. it is grobal": "insult",
        "not here\nit is grobal": "insult",
        "we will kill them": "meant threat",
        "they kill time": "threat",
        "we will not kill them": None,
    }
    found = scorer.features(pa.array([*kinds]))
    for row, kind in zip(found, kinds.values(), strict=True):
        assert [toxicity.KINDS[k] for k in np.flatnonzero(row)] == ([kind] if kind else [])


def test_held_out_is_crc32(spark):
    rows = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("held")).collect()
    assert [r.held for r in rows] == [is_held_out(r.id) for r in rows]


@pytest.fixture(scope="module")
def tongues(spark):
    draw = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "pf", "ung"], "cc": ["ци", "ла", "но", "жу"]}

    def text(lang, n):
        return " ".join("".join(draw.choice(syllables[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n))

    rows = [(i, text(lang, draw.randrange(3, 40)), lang if i % 9 else None) for i, lang in enumerate(draw.choice([*syllables]) for _ in range(300))]
    rows += [(1000, f"{text('aa', 40)} {text('bb', 15)} {text('cc', 5)}", None), (1001, None, "aa"), (1002, "12 34 ... !", "bb"), (1003, "日本", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3), rows


def test_languages_and_spans(tongues):
    docs, rows = tongues
    model = languages.learn(docs)
    assert model.languages == ["aa", "bb", "cc"] and model.scripts["Cyrillic"] == [False, False, True]
    found = {r.doc_id: r for r in languages.tag_languages(docs, model).collect()}
    assert all(found[i].lang_pred == lang for i, text, lang in rows if lang and i < 1000 and is_held_out(i))
    assert [(s.n_words, s.lang) for s in found[1000].lang_spans] == [(40, "aa"), (15, "bb"), (5, "cc")]
    assert found[1000].lang_pred == "aa" and found[1000].lang_score == pytest.approx(40 / 60)
    assert (found[1001].lang_pred, found[1001].lang_score) == ("und", 0.0) and found[1002].lang_pred == "und"
    assert found[1003].lang_pred in model.languages


def test_viterbi_is_the_best_path(tongues):
    import itertools

    from repoquarry.llm.texts import words

    model = languages.Model(["a", "b", "c"], {}, np.zeros((1, 3)), {})
    draw = np.random.default_rng(0)
    found = words(pa.array([b"x y z x", b"", b"z", b"y y x z z x"], pa.binary()))
    for _ in range(20):
        scores = draw.normal(size=(len(found.table), 3)) * 3
        path = languages.Tagger(model, 1.5).paths(found, scores)
        for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True):
            own = scores[found.codes[a:b]]

            def value(p, own=own):
                return sum(own[k][x] for k, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:], strict=False))

            best = max((value(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
            assert value(path[a:b].tolist()) == pytest.approx(best)


def test_languages_of_odd_documents(odd, empty, tongues):
    model = languages.learn(tongues[0])
    rows = languages.tag_languages(odd, model, with_spans=False).collect()
    assert len(rows) == len(ODD) and all(0 <= r.lang_score <= 1 for r in rows)
    assert all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in r.text or ""))
    nothing = languages.learn(empty)
    assert nothing.languages == [] and {r.lang_pred for r in languages.tag_languages(odd, nothing).collect()} == {"und"}
    assert languages.tag_languages(empty, model).collect() == []


def truth(vectors, k):
    good = {i: np.array(v, float) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    result = []
    for q in good:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
            result += [(q, rank + 1, i, round(d, 9)) for rank, (d, i) in enumerate(near)]
    return sorted(result)


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    rows += [(i, rows[5][1]) for i in range(900, 1200)]  # one very common vector
    rows += [(1200, None), (1210, [0.0] * 8), (1220, [float("nan")] * 8), (1230, [1.0, None] * 4), (1240, [float("inf")] * 8), (1250, []), (None, [1.0] * 8)]
    rows += [(10, rows[10][1]), (1260, [1.0, 2.0]), (1261, [1.0, 3.0])]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)


def test_nearest_against_brute_force(vectors):
    rows, df = vectors
    for shard, block in ((5000, 20_000), (150, 40)):
        found = nearest.nearest(df, F.col("vec_id") % 10 == 0, k=10, shard_rows=shard, block_queries=block).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found) == truth(rows, 10)
    assert nearest.nearest(df.filter("false"), F.col("vec_id") % 10 == 0).collect() == []


def test_relaxed_pruning_keeps_recall(vectors):
    rows, df = vectors
    found = nearest.nearest(df, F.col("vec_id") % 10 == 0, k=10, factor=1.3, shard_rows=300).collect()
    exact = {(q, i) for q, _, i, _ in truth(rows, 10)}
    assert len(exact & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(exact)


def test_model_queries_on_a_table(spark, tmp_path, odd, labelled):
    docs, labels = labelled
    odd.select("doc_id", "text", "lang").unionByName(docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op4_toxicity", "op10_languages"):
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(rows) == len(ODD) + 600
        assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)


def test_pipeline_stages_follow_brute_force(spark, tmp_path, labelled, corpus):
    from .test_dedup import lower, near_truth, substring_truth

    base, labels = labelled
    text = dict(corpus)
    rows = [(i, "en", "s", len(t), t + ("\na line all documents share" if i % 3 == 0 else "") + (" grobal" if i % 11 == 0 else "")) for i, t in text.items()]
    docs = spark.createDataFrame([(i + 2000, t, lang, s, n) for i, lang, s, n, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    train = base.selectExpr("doc_id", "text", "lang", "'s' as source", "0L as n_chars")
    docs.unionByName(train).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(((r.doc_id, r.text) for r in now.collect()))
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.columns == now.columns
            rows = sorted((r.doc_id, r.text) for r in after.collect())
        if name == "toxicity":
            assert [i for i, _ in rows] == [i for i, t in before if "grob" not in t]
        elif name == "line_dedup":
            owner = {}
            for i, t in before:
                for line in t.split("\n"):
                    owner.setdefault(lower(line.strip()), i)
            assert rows == [(i, "\n".join(x for x in t.split("\n") if len(x.strip()) < 10 or owner[lower(x.strip())] == i)) for i, t in before]
        elif name == "near_dedup":
            stay = {i for i, first, _ in map(ast.literal_eval, near_truth(before)) if i == first}
            assert rows == [(i, t) for i, t in before if i in stay]
        elif name == "substring_dedup":
            left = {i: t for i, _, _, t in map(ast.literal_eval, substring_truth(before))}
            assert [(i, " ".join(t.split())) for i, t in rows] == [(i, left[i]) for i, _ in before]
            assert all(r.n_chars == len(r.text) for r in after.collect())
        else:
            assert sorted({r.doc_id for r in after.collect()}) == [i for i, _ in before]
        now = after
    assert one_row(corpus_pipeline.run(spark, str(tmp_path)).groupBy().count())[0] == now.count()
