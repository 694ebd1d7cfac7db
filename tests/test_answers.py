from __future__ import annotations

import random

from repoquarry.operators import answers


def parse(spark, *texts):
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "repo_id string, response_id int, text string")
    found = answers.parse_important_files(df).orderBy("response_id", "ordinal").collect()
    return [(r.response_id, r.file_path, r.importance_level, r.confidence_score, r.reasons, r.content_type, r.estimated_lines, r.source) for r in found]


def test_json_shapes(spark):
    got = parse(
        spark,
        'x ```json\n[{"file_path": "a", "confidence_score": "0.5"}, 3, null]\n``` y',
        '```json {"files": [{"file_path": "b", "importance_level": "LOW", "reasons": ["p", "q"]}]}',
        '{"important_files": [{"file_path": "c", "estimated_lines": 12.9, "confidence_score": true, "reason": "only"}]}',
        '{"file_path": "d", "confidence_score": null, "estimated_lines": null, "content_type": "t"}',
        "[]", "7", '{"files": "none"}',
    )
    assert got == [
        (0, "a", "MEDIUM", 0.5, [], "", 100, "json"),
        (1, "b", "LOW", 0.7, ["p", "q"], "", 100, "json"),
        (2, "c", "MEDIUM", 1.0, ["only"], "", 12, "json"),
        (3, "d", "MEDIUM", 0.7, [], "t", 100, "json"),
    ]


def test_bad_numbers_drop_all_json(spark):
    bad = '[{"file_path": "good"}, {"file_path": "x/y.py", "confidence_score": "abc"}]\n- src listed'
    fractional = '{"file_path": "x", "estimated_lines": "10.5"}'
    listed = '{"file_path": "x", "confidence_score": [1]}'
    got = parse(spark, bad, fractional, listed)
    assert [(g[0], g[7]) for g in got] == [(0, "text")]


def test_text_fold(spark):
    got = parse(spark, "The file src/a.py follows\n- why", "src/a.py CRITICAL", "- early\nsee `src/b.ts`, HIGH\n\nlib/x.go\n---\n", "a/x.py\nb/y.py because\nz")
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [
        (0, "src/a.py", "LOW", ["why"]), (2, "src/b.ts", "HIGH", ["early"]), (2, "lib/x.go", "MEDIUM", [""]), (3, "b/y.py", "MEDIUM", ["b/y.py because"]),
    ]


def model(text: str):
    """The rules of the text fold, written down plainly."""
    out, held, level, reasons = [], None, "MEDIUM", []
    for line in (raw.strip() for raw in text.split("\n")):
        names = any(s in line for s in (".py", ".js", ".ts", ".java", ".go", ".cpp", ".c", ".rb"))
        if names and ("/" in line or "\\" in line):
            words = [w for w in line.split() if any(s in w for s in (".py", ".js", ".ts", ".java", ".go"))]
            held = words[0].strip(":`\"'(),") if words else held
        level = next((n for n in ("CRITICAL", "HIGH", "MEDIUM", "LOW") if n in line.upper()), level)
        if line[:1] in ("-", "*") and line or "because" in line.lower():
            reasons.append(line.strip("- *"))
        if held and (reasons or not line or line.startswith("---")):
            out.append((held, level, list(reasons)))
            held, level, reasons = None, "MEDIUM", []
    return out


def test_text_fold_equals_model(spark):
    random.seed(11)
    pieces = ["src/a.py", "`lib\\b.ts`:", "(x/y.go),", "main.c", "q/w.rb", "CRITICAL", "high", "follows", "- r", "* s *", "---", "Because", "", "  ", "\t", "word", "-", "a.py/b"]
    texts = ["\n".join(" ".join(random.choices(pieces, k=random.randrange(4))) for _ in range(random.randrange(9))) for _ in range(500)]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "repo_id string, response_id int, text string")
    got = [(r.response_id, r.file_path, r.importance_level, r.reasons) for r in answers.extract_files_from_text(df).orderBy("response_id", "ordinal").collect()]
    assert got == [(i, *row) for i, t in enumerate(texts) for row in model(t)]
    assert len(got) > 200


def test_large_numbers_keep_the_answer(spark):
    text = '[{"file_path": "a.py", "estimated_lines": 3000000000}, {"file_path": "b.py", "estimated_lines": "5000000000", "confidence_score": 1}]'
    found = answers.parse_important_files(spark.createDataFrame([("r", "1", text)], "repo_id string, response_id string, text string"))
    assert [(r.file_path, r.estimated_lines, r.source) for r in found.orderBy("ordinal").collect()] == [("a.py", 3000000000, "json"), ("b.py", 5000000000, "json")]
