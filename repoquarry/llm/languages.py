"""Language of texts and of their spans: scripts narrow the candidates, Viterbi over words with a penalty for switching decides.

Words are scored by character trigrams counted per language; a word is scored only under languages that use its script. The path
of languages through a text that scores best, less the penalty at every change, labels each word, so mixed texts fall into spans.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoquarry.llm.sentence_pieces import put
from repoquarry.llm.tables import map_arrow, written
from repoquarry.llm.texts import Words, filled, slices, words
from repoquarry.llm.toxicity import held_out
from repoquarry.operators.skew import first_rows

# Ranges of code points of scripts, from the Unicode blocks.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x531, 0x58F)],
    "Hebrew": [(0x591, 0x5F4)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_SCRIPT_OF = [(low, high, name) for name, ranges in SCRIPTS.items() for low, high in ranges]


def script(word: str) -> str | None:
    """Script of the first letter with a known one; none for words without letters."""
    for char in word:
        if char.isalpha():
            return _script_of(char)
    return None


@cache
def _script_of(letter: str) -> str:
    point = ord(letter)
    return next((name for low, high, name in _SCRIPT_OF if low <= point <= high), "other")


def trigrams(word: str) -> list[str]:
    marked = f"  {word} "
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


def _core(token: bytes) -> str:
    """Letters of the token in lower case; marks and digits inside part nothing."""
    text = token.decode("utf-8", "replace").lower()
    return text if text.isalpha() else "".join(filter(str.isalpha, text))


class Model(NamedTuple):
    languages: list[str]
    trigrams: dict[str, int]
    """Row of each trigram in `scores`."""
    scores: np.ndarray
    """Log-probability of a trigram under each language; the last row is for unknown trigrams."""
    scripts: dict[str, list[bool]]
    """Which languages use a script."""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: defaultdict[str, Counter] = defaultdict(Counter)
    for batch in slices(batches, "text"):
        found = words(filled(batch.column("text")))
        cores = [_core(t) for t in found.table.to_pylist()]
        parts = [(script(c) or "", trigrams(c)) if c else ("", []) for c in cores]
        labels = np.array(batch.column("lang").to_pylist())
        of_word = np.repeat(labels, np.diff(found.offsets))
        for lang in np.unique(labels):
            own = found.codes[of_word == lang]
            for code in np.flatnonzero(uses := np.bincount(own, minlength=len(cores))).tolist():
                n = int(uses[code])
                for gram in parts[code][1]:
                    counts[lang][gram] += n
                if parts[code][0]:
                    counts[lang]["script:" + parts[code][0]] += n
    rows = [(lang, gram, n) for lang, own in counts.items() for gram, n in own.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])


def learn(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_docs: int | None = 5_000, most_trigrams: int | None = 15_000, least_script: float = 0.02
) -> Model:
    """Trigram counts from at most `most_docs` documents of each language, outside the held-out quarter, by id hash.

    The `most_trigrams` most frequent trigrams of each language come to the driver, so neither documents nor trigrams of a rare language give
    way to those of a large one. None stands for no bound. A language uses a script if at least `least_script` of its words
    are written in it. Without labelled documents the model knows no language and every text is `und`.
    """
    known = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(lang).cast("string").alias("lang")).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id"))
    )
    chosen = known.groupBy("id").agg(F.min("lang").alias("lang"))
    if most_docs is not None:
        chosen = F.broadcast(first_rows(chosen, ["lang"], [F.xxhash64("id").asc(), F.asc("id")], most_docs).select("id", "lang"))
    sample = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).join(chosen, "id")
    counted = map_arrow(sample.select("text", "lang"), _count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = written(counted, "trigrams")
    kept = counted.groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    is_script = F.col("gram").startswith("script:")
    trigrams = kept.filter(~is_script)
    if most_trigrams is not None:
        frequent = first_rows(counted.filter(~is_script), ["lang"], [F.desc("n"), F.asc("gram")], most_trigrams).select("gram").distinct()
        trigrams = trigrams.join(frequent, "gram", "left_semi")
    rows = trigrams.orderBy(F.desc("all"), "gram").collect()
    script_rows = kept.filter(is_script).collect()  # at most one row for each script
    languages = sorted({name for r in [*rows, *script_rows] for name in r["by"]})
    counts = np.zeros((len(rows) + 1, len(languages)))
    for i, r in enumerate(rows):
        counts[i] = [r["by"].get(name, 0) for name in languages]
    scores = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts)))
    uses = {r["gram"].removeprefix("script:"): np.array([r["by"].get(name, 0) for name in languages], float) for r in script_rows}
    total = sum(uses.values(), np.zeros(len(languages))) + 1e-9
    return Model(languages, {r["gram"]: i for i, r in enumerate(rows)}, scores, {s: (n / total >= least_script).tolist() for s, n in uses.items()})


_IMPOSSIBLE = -1e4


class Tagger:
    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty

    def word_scores(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each token under each language, and which tokens have a letter. Tokens that tell nothing score 0."""
        lettered = np.zeros(len(tokens), bool)
        grams, owner = [], []
        allowed: dict[int, list[bool]] = {}
        unknown = len(self.model.trigrams)
        row_of = self.model.trigrams
        for i, token in enumerate(tokens):
            core = _core(token)
            if not core:
                continue
            lettered[i] = True
            candidates = self.model.scripts.get(script(core) or "")
            if candidates is None or not any(candidates):
                continue  # a script no known language uses
            if not all(candidates):
                allowed[i] = candidates
            own = [row_of.get(g, unknown) for g in trigrams(core)]
            grams.extend(own)
            owner.extend([i] * len(own))
        scores = np.zeros((len(tokens), len(self.model.languages)))
        if grams:
            at = np.array(owner)
            rows = self.model.scores[np.array(grams)]
            for k in range(scores.shape[1]):
                scores[:, k] = np.bincount(at, rows[:, k], len(tokens))
        for i, candidates in allowed.items():
            scores[i, ~np.array(candidates)] = _IMPOSSIBLE
        return scores - scores.max(1, keepdims=True) if len(tokens) and scores.shape[1] else scores, lettered

    def paths(self, found: Words, scores: np.ndarray) -> np.ndarray:
        """Language of each word on the best path of its text; texts advance together, word by word, from the longest to the shortest."""
        lengths = np.diff(found.offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, sorted_lengths = found.offsets[:-1][order], lengths[order]
        n_langs = scores.shape[1]
        best = np.zeros((len(order), n_langs))
        switched = np.zeros((len(found.codes), n_langs), bool)
        leader = np.zeros(len(found.codes), np.int8 if n_langs < 128 else np.int32)
        result = np.zeros(len(found.codes), leader.dtype)
        longest = int(sorted_lengths[0]) if len(order) else 0
        active_at = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")
        for t in range(longest):
            n = active_at[t]
            at = starts[:n] + t
            now = best[:n]
            if t:
                top = now.argmax(1)
                jump = now[np.arange(n), top][:, None] - self.penalty
                worse = now < jump
                switched[at], leader[at] = worse, top
                now = np.where(worse, jump, now)
            now = now + scores[found.codes[at]]
            best[:n] = now - now.max(1, keepdims=True)
        state = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            n = active_at[t]
            at = starts[:n] + t
            result[at] = state[:n]
            state[:n] = np.where(switched[at, state[:n]], leader[at], state[:n])
        return result

    def tag(self, texts: pa.Array, with_spans: bool) -> tuple[list[str], np.ndarray, list]:
        found = words(filled(texts))
        scores, lettered = self.word_scores(found.table.to_pylist())
        names = self.model.languages
        if not names:
            return ["und"] * len(texts), np.zeros(len(texts)), [[]] * len(texts)
        path = self.paths(found, scores)
        of_text = np.repeat(np.arange(len(texts)), np.diff(found.offsets))
        told = lettered[found.codes] if len(found.codes) else np.zeros(0, bool)
        votes = np.bincount((of_text * len(names) + path)[told], minlength=len(texts) * len(names)).reshape(len(texts), len(names))
        # Among equally many words the language under which the whole text scores better.
        sums = np.stack([np.bincount(of_text, scores[found.codes, k], len(texts)) for k in range(len(names))], 1) if len(found.codes) else votes * 0.0
        total = votes.sum(1)
        chosen = np.array([int(np.lexsort((s, v))[-1]) for s, v in zip(sums, votes, strict=True)], np.int64)
        lang = [names[c] if n else "und" for c, n in zip(chosen, total.tolist(), strict=True)]
        score = np.where(total > 0, votes[np.arange(len(texts)), chosen] / np.maximum(total, 1), 0.0)
        spans = []
        if with_spans:
            for a, b in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
                own = path[a:b]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), b - a] if b > a else [0]
                spans.append([{"first_word": x, "n_words": y - x, "lang": names[own[x]]} for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
        return lang, score, spans


SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("lang", T.StringType())]))


def tag_languages(docs: DataFrame, model: Model, text: str = "text", penalty: float = 8.0, with_spans: bool = True) -> DataFrame:
    """All columns of `docs`, `lang_pred`, `lang_score` and, if asked for, `lang_spans` (ranges of words by language).

    Whole texts are read. `lang_pred` is the language of most words with letters on the best path, `lang_score` their share; both are
    `und` and 0 for null texts and texts without letters. Columns of these names are replaced. Rows are independent.
    """
    spans_type = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model, penalty)
        for batch in slices(batches, text):
            lang, score, spans = tagger.tag(batch.column(text), with_spans)
            batch = put(put(batch, "lang_pred", pa.array(lang, pa.string())), "lang_score", pa.array(score, pa.float64()))
            yield put(batch, "lang_spans", pa.array(spans, spans_type)) if with_spans else batch

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())] + [T.StructField("lang_spans", SPANS)] * with_spans
    names = {f.name for f in new}
    return map_arrow(docs, run, T.StructType([f for f in docs.schema.fields if f.name.lower() not in names] + new))
