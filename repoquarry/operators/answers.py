"""Model answers (semi-structured text) as typed rows.

Everything happens inside one projection per answer: JSON through VARIANT, free text through a fold over its lines.
No shuffle, no Python row processing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import fixed, text
from repoquarry.functions.paths import any_of, col
from repoquarry.functions.rows import unfold

FENCE = "```json"
FILE_TYPE = (
    "struct<file_path: string, importance_level: string, confidence_score: double, "
    "reasons: array<string>, content_type: string, estimated_lines: bigint>"
)
FILES_TYPE = f"array<{FILE_TYPE}>"


def extract_fenced_json(answer: Column | str) -> Column:
    """Text inside the first JSON fence, stripped; an unclosed fence takes the rest, no fence the whole text."""
    t = col(answer)
    after = F.substr(t, F.instr(t, FENCE) + len(FENCE))
    inside = text.strip_text(F.substring_index(after, "```", 1))
    return F.when(F.contains(t, F.lit(FENCE)), inside).otherwise(t)


def _object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _items(parsed: Column) -> Column:
    """Objects of a parsed answer: a list, the list under "files" or "important_files", or the answer itself."""
    as_object = _object(parsed)

    def under(name: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", "array<variant>")

    none = F.array().cast("array<variant>")
    listed = (
        F.when(F.map_contains_key(as_object, "files"), under("files"))
        .when(F.map_contains_key(as_object, "important_files"), under("important_files"))
        .when(as_object.isNotNull(), F.array(parsed))
        .otherwise(F.try_variant_get(parsed, "$", "array<variant>"))
    )
    return F.coalesce(F.filter(listed, lambda item: _object(item).isNotNull()), none)


def _kind(item: Column, field: str) -> Column:
    """JSON kind of a field: null when missing, VOID for null, STRING, BOOLEAN, a number type, ARRAY..., OBJECT..."""
    return F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))


_FLOAT = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
_INT = r"^\s*[+-]?\d+\s*$"


def _number(item: Column, field: str, type_name: str, pattern: str) -> Column:
    """Number of a field: JSON numbers and booleans as they are, texts when they spell one; null otherwise."""
    kind = _kind(item, field)
    raw = F.regexp_replace(F.try_variant_get(item, f"$.{field}", "string"), r"(?<=\d)_(?=\d)", "")
    # What is spelled as a number stays one: beyond the type's range the nearest value is taken.
    wide = text.strip_text(raw).try_cast("double").cast(type_name)
    spelled = F.when(raw.rlike(pattern), F.coalesce(text.strip_text(raw).try_cast(type_name), wide))
    return (
        F.when(kind == "STRING", spelled)
        .when(kind == "BOOLEAN", F.try_variant_get(item, f"$.{field}", "boolean").cast("int").cast(type_name))
        .when(
            ~kind.rlike("^(ARRAY|OBJECT)"),
            F.coalesce(F.try_variant_get(item, f"$.{field}", type_name), F.try_variant_get(item, f"$.{field}", "double").cast(type_name)),
        )
    )


def _is_bad(item: Column) -> Column:
    """A number field is there, not null, and is no number."""

    def bad(field: str, type_name: str, pattern: str) -> Column:
        present = F.coalesce(_kind(item, field), F.lit("VOID")) != "VOID"
        return present & _number(item, field, type_name, pattern).isNull()

    return bad("confidence_score", "double", _FLOAT) | bad("estimated_lines", "bigint", _INT)


def _file(item: Column) -> Column:
    def string(field: str, default: str) -> Column:
        return F.coalesce(F.try_variant_get(item, f"$.{field}", "string"), F.lit(default))

    def reasons(field: str) -> Column:
        several = F.try_variant_get(item, f"$.{field}", "array<string>")
        return F.coalesce(several, F.filter(F.array(F.try_variant_get(item, f"$.{field}", "string")), lambda r: r.isNotNull() & (_kind(item, field) == "STRING")))

    # "reasons" wins; a single "reason" is accepted too.
    given = F.when(_kind(item, "reasons").isNotNull(), reasons("reasons")).otherwise(reasons("reason"))
    return F.struct(
        string("file_path", "").alias("file_path"),
        string("importance_level", "MEDIUM").alias("importance_level"),
        F.coalesce(_number(item, "confidence_score", "double", _FLOAT), F.lit(0.7)).alias("confidence_score"),
        F.coalesce(given, F.array().cast("array<string>")).alias("reasons"),
        string("content_type", "").alias("content_type"),
        F.coalesce(_number(item, "estimated_lines", "bigint", _INT), F.lit(100).cast("bigint")).alias("estimated_lines"),
    )


def files_in_text(answer: Column | str) -> Column:
    """Array of the files a free-text answer names: a fold over its lines.

    State: the file held, the level last seen, the reasons collected, the files given out. A held file is given out at
    the first line where it has reasons, or at a blank or dashed line; one still held at the end is not.
    """
    state_type = f"struct<cur: string, level: string, reasons: array<string>, out: {FILES_TYPE}>"
    start = F.struct(
        F.lit(None).cast("string").alias("cur"),
        F.lit("MEDIUM").alias("level"),
        F.array().cast("array<string>").alias("reasons"),
        F.array().cast(FILES_TYPE).alias("out"),
    ).cast(state_type)

    line_regex, word_regex = any_of(fixed.ANSWER_LINE_SUFFIXES), any_of(fixed.ANSWER_WORD_SUFFIXES)
    marks = ":`\"'(),"

    def observe(state: Column, line: Column) -> Column:
        word = F.try_element_at(F.filter(F.split(line, r"(?U)[\s\x1c-\x1f]+"), lambda w: w.rlike(word_regex)), F.lit(1))
        names_file = line.rlike(line_regex) & line.rlike(r"[/\\]")
        held = F.regexp_replace(word, rf"^[{marks}]+|[{marks}]+\z", "")
        upper = F.upper(line)
        level = F.lit(None).cast("string")
        for name in reversed(fixed.ANSWER_LEVELS):
            level = F.when(upper.contains(name), F.lit(name)).otherwise(level)
        is_reason = line.startswith("-") | line.startswith("*") | F.lower(line).contains("because")
        reason = F.regexp_replace(line, r"^[- *]+|[- *]+\z", "")
        return F.struct(
            F.coalesce(F.when(names_file, held), state["cur"]).alias("cur"),
            F.coalesce(level, state["level"]).alias("level"),
            F.when(is_reason, F.array_append(state["reasons"], reason)).otherwise(state["reasons"]).alias("reasons"),
            state["out"].alias("out"),
            (line.eqNullSafe("") | line.startswith("---")).alias("ends"),
        )

    def give_out(seen: Column) -> Column:
        due = seen["cur"].isNotNull() & (seen["cur"] != "") & ((F.size(seen["reasons"]) > 0) | seen["ends"])
        found = F.struct(
            seen["cur"].alias("file_path"),
            seen["level"].alias("importance_level"),
            F.lit(0.6).alias("confidence_score"),
            seen["reasons"].alias("reasons"),
            F.lit("Extracted from text analysis").alias("content_type"),
            F.lit(150).alias("estimated_lines"),
        ).cast(FILE_TYPE)
        return F.struct(
            F.when(~due, seen["cur"]).alias("cur"),
            F.when(due, F.lit("MEDIUM")).otherwise(seen["level"]).alias("level"),
            F.when(due, F.array().cast("array<string>")).otherwise(seen["reasons"]).alias("reasons"),
            F.when(due, F.array_append(seen["out"], found)).otherwise(seen["out"]).alias("out"),
        ).cast(state_type)

    def step(state: Column, line: Column) -> Column:
        # SQL lambdas have no "let": one-element arrays bind the stripped line and the observed state once.
        stripped = F.array(text.strip_text(line))
        return F.transform(F.transform(stripped, lambda s: observe(state, s)), give_out)[0]

    return F.aggregate(F.split(col(answer), "\n", -1), start, step, lambda state: state["out"])


def parse_important_files(responses: DataFrame) -> DataFrame:
    """Rows `(repo_id, response_id, ordinal, file columns, source)` of answers `(repo_id, response_id, text)`.

    If an answer is no JSON, or one of its numbers is no number, all of it is read as free text instead.
    """
    parsed = responses.withColumn("parsed", F.try_parse_json(extract_fenced_json("text")))
    items = parsed.withColumn("items", F.when(F.col("parsed").isNotNull(), _items(F.col("parsed"))))
    as_text = F.col("items").isNull() | F.exists("items", _is_bad)
    chosen = items.withColumn("as_text", as_text).select(
        "repo_id",
        "response_id",
        F.when(F.col("as_text"), "text").otherwise("json").alias("source"),
        F.when(F.col("as_text"), files_in_text("text")).otherwise(F.transform("items", _file).cast(FILES_TYPE)).alias("found"),
    )
    rows = unfold(chosen, ["repo_id", "response_id", "source"], F.col("found"), "file", "position")
    return rows.select(
        "repo_id", "response_id", (F.col("position") + 1).cast("bigint").alias("ordinal"), "file.*", "source"
    )


def extract_files_from_text(responses: DataFrame) -> DataFrame:
    """Every answer read as free text: `(repo_id, response_id, ordinal, file columns)`."""
    rows = unfold(responses, ["repo_id", "response_id"], files_in_text("text"), "file", "position")
    return rows.select("repo_id", "response_id", (F.col("position") + 1).cast("bigint").alias("ordinal"), "file.*")
