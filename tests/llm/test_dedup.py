from __future__ import annotations

import ast
import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from repoquarry.llm import exact_dedup, line_dedup, near_dedup, queries, shingles, substring_dedup
from repoquarry.llm.suffix_automaton import SuffixAutomaton

from .conftest import ODD

WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_lines_against_brute_force(odd, empty):
    owner = {}
    last = 1 << 63
    for i, text in ODD:
        for line in (text or "").split("\n"):
            key = lower(line.strip(WHITE))
            if len(key) >= 10:
                owner[key] = min(owner.get(key, last), last if i is None else i)
    expected = []
    for i, text in ODD:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := lower(x.strip(WHITE))) < 10 or owner[k] == (last if i is None else i)]
        expected.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    for batches in (1, 3):
        rows = line_dedup.dedup_lines(odd, batches=batches).collect()
        assert sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows))) == sorted(map(str, expected))
        assert {r.source for r in rows} == {"s"} and {r["class"] for r in rows} == {"kept"}
    assert line_dedup.dedup_lines(empty).collect() == []


def test_runs_take_later_batches(spark):
    runs = line_dedup.LineRuns(spark, buckets=2, fanout=2)
    first = spark.createDataFrame([(1, "a line of the first batch"), (2, "shared by all the batches")], "doc_id bigint, text string")
    later = spark.createDataFrame([(7, "shared by all the batches\na line of the first batch\nnew in the last batch")], "doc_id bigint, text string")
    assert [r.n_dropped for r in line_dedup.dedup_lines(first, runs=runs).collect()] == [0, 0]
    assert [(r.text, r.n_dropped) for r in line_dedup.dedup_lines(later, runs=runs).collect()] == [("new in the last batch", 2)]
    assert len(runs.levels) > 1 and runs.owners().count() == 3
    runs.close()


@pytest.mark.parametrize("bits,block", [(64, 4096), (64, 7), (3, 5)])
def test_exact_groups_against_brute_force(odd, bits, block):
    groups = defaultdict(list)
    for i, text in ODD:
        groups[lower(text or "")].append(i)
    expected = sorted(
        str((i, max((x for x in own if x is not None), default=None), len(own), hashlib.sha256(text.encode()).hexdigest())) for text, own in groups.items() for i in own
    )
    rows = exact_dedup.exact_groups(odd, block_bytes=block, hash_bits=bits).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == expected
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_groups_run_no_python(odd, empty):
    plan = exact_dedup.exact_groups(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert exact_dedup.exact_groups(empty).collect() == []


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def near_truth(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    classes = defaultdict(list)
    for k in range(len(rows)):
        classes[find(k)].append(rows[k][0])
    return sorted(str((i, min((x for x in own if x is not None), default=None), len(own))) for own in classes.values() for i in own)


def test_near_classes_against_brute_force(spark, corpus, odd, empty):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(4)
    rows = near_dedup.near_classes(docs).collect()
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in rows) == near_truth(corpus)
    kept = near_dedup.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.class_id for r in rows})
    rows = near_dedup.near_classes(odd).collect()
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in rows) == near_truth(ODD)
    assert near_dedup.keep_one(odd).columns == odd.columns
    assert near_dedup.near_classes(empty).collect() == []


def repeated_lines(repeats=400):
    """Near copies of which one repeats a line or a paragraph many times, around texts of their own."""
    rows = []
    for g in range(12):
        words = [f"g{g}w{k}" for k in range(200)]
        line = " ".join(words[90:100])
        text = " ".join(words)
        rows.append((4 * g, text))
        rows.append((4 * g + 1, " ".join([text, *[line] * (repeats if g % 2 else 40)])))
        rows.append((4 * g + 2, " ".join([*[line] * repeats, text, "end"])))
        rows.append((4 * g + 3, " ".join([*words[:100], *[f"o{g}w{k}" for k in range(100)], *[line] * repeats])))
    return rows


def test_near_copies_with_repeated_lines(spark):
    rows = repeated_lines()
    truth = near_truth(rows)
    assert sum(f", {4 * g}, 3)" in text for g in range(12) for text in truth) == 36
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in near_dedup.near_classes(docs).collect()) == truth


def test_joined_pairs_need_no_alike_signatures(spark, monkeypatch):
    rows = [(g, " ".join([f"c{k}" for k in range(100)] + [f"g{g // 2}w{k}" for k in range(30)] + [f"own{g}"])) for g in range(16)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_dedup, "_alike", lambda proposals, notes, least: proposals.filter("false"))
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in near_dedup.near_classes(docs).collect()) == near_truth(rows)


def test_chains_are_one_class(spark):
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(12):  # each near the one before, the first and the last far apart
        rows.append((i, " ".join(words)))
        words[i * 20] = f"z{i}"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in near_dedup.near_classes(docs).collect()) == near_truth(rows)


def test_signatures_estimate_weighted_similarity():
    common, own, other = "a b c d e " * 40, " ".join(f"x{k}" for k in range(30)), " ".join(f"y{k}" for k in range(30))
    found = shingles.shingles(pa.array([f"{common} {own}", f"{common} {other}", f"{common} {own}"]))
    first, second, again = shingles.signatures(found, 1999)
    weights = [dict(zip(found.hashes[a:b].tolist(), found.counts[a:b].tolist(), strict=True)) for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]
    x, y = weights[0], weights[1]
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    assert (first == second).mean() == pytest.approx(exact, abs=0.05)
    assert (first == again).all()


def substring_truth(rows, window=13):
    last = 1 << 63
    first = {}
    texts = [(last if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, words in texts:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(i, first.get(key, last))
    result = []
    for (i, words), (shown, _) in zip(texts, rows, strict=True):
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        result.append(str((shown, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))))
    return sorted(result)


@pytest.mark.parametrize("shard", [5000, 2])
def test_substrings_against_brute_force(spark, corpus, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", shard)
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(6)
    rows = substring_dedup.dedup_substrings(docs).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, " ".join(r.text.split()))) for r in rows) == substring_truth(corpus)


def test_substrings_of_odd_documents(odd, empty):
    rows = substring_dedup.dedup_substrings(odd).collect()
    found = sorted(str((r.doc_id, r.n_words, r.n_removed, " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))) for r in rows)
    assert found == substring_truth(ODD)
    assert {r.n_lines for r in rows} == {"kept"} and sum(r.text is None for r in rows) == 2
    assert substring_dedup.dedup_substrings(empty).collect() == []


@pytest.mark.parametrize("shard", [5000, 2])
def test_substrings_of_rows_that_share_an_id(spark, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", shard)
    passage = " ".join(f"p{k}" for k in range(30))

    def own(i, n=60):
        return " ".join(f"d{i}w{k}" for k in range(n))

    rows = [(1, f"{own(1)} {passage}"), (2, own(2)), (3, f"{passage} {own(3)}"), (3, own(4)), (3, f"{own(5, 7)} {passage} {own(5)}"), (3, None), (3, own(6, 5))]
    rows += [(None, f"{own(7)} {passage}"), (None, own(8)), (None, own(8)), (None, own(9, 4)), (None, None), (None, f"{own(10, 20)} {passage} {own(2)}")]
    rows += [(4, f"{own(11)} {own(8)}"), (4, f"{own(12, 3)} {own(11)}"), (5, own(13)), (5, f"{own(14, 9)} {own(4, 20)}"), (None, own(15))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for parts in (1, 5):
        found = substring_dedup.dedup_substrings(docs.repartition(parts)).collect()
        assert sorted(str((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").split()))) for r in found) == substring_truth(rows)


def test_automaton_knows_the_first_of_every_window():
    draw = np.random.default_rng(5)
    sequences = [draw.integers(0, 3, draw.integers(1, 30)).tolist() for _ in range(60)]
    automaton = SuffixAutomaton()
    for i, s in enumerate(sequences):
        automaton.add(s, i)
    for width in (1, 3, 6):
        for probe in [*sequences, draw.integers(0, 4, 40).tolist()]:
            expected = []
            for end in range(1, len(probe) + 1):
                part = probe[end - width : end] if end >= width else None
                holders = [i for i, s in enumerate(sequences) if part and any(s[k : k + width] == part for k in range(len(s) - width + 1))]
                expected.append(min(holders, default=-1))
            assert automaton.firsts(probe, width) == expected


def test_op_queries_on_a_table(spark, tmp_path, odd):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    n = len(ODD)
    for name in ("op3_line_dedup", "op6_exact_dedup", "op7_near_dedup", "op8_substring_dedup"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == n
    kept = {(r.doc_id, r.n_words, r.n_removed): r.kept_sha256 for r in queries.op8_substring_dedup(spark, str(tmp_path)).collect()}
    for text in substring_truth(ODD):
        i, words, gone, left = ast.literal_eval(text)
        assert kept[i, words, gone] == hashlib.sha256(left.encode()).hexdigest()
