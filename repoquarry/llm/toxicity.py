"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, intent, other. Insults are stems and words whose weights are
learned from labels, in any language; the other symbols are short word lists. Small transducers read the symbols of a clause:
one marks insults aimed at somebody, one those under a negation, one those in reported speech, one threats that are meant. Their
composition is one machine that reads a clause once and puts out every insult and threat with its marks. A document is scored by
what its matched clauses add up to, by kind of match; a word alone counts for what its clause makes of it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.tables import map_arrow, written
from repoquarry.llm.texts import Words, filled, mix, slices, words

# Function words of the languages of the corpora this is for.
TARGETS = "you your you're youre u he she they them him his her their these those du dich dir dein deine ihr euch tu toi te vous votre ils elles tú ti usted ustedes ellos".split()
NEGATIONS = "not no never neither nor isn't aren't don't doesn't wasn't without nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans nunca jamás ningún sin".split()
REPORTS = "said says say wrote writes called calls quoted quotes reported claimed sagte sagt schrieb nannte zitierte dit disait écrit selon dijo dice escribió llamó según".split()
THREATS = "kill hurt destroy shoot stab burn beat hang die töten umbringen erschießen schlagen verbrennen tuer frapper brûler mourir matar golpear quemar morir".split()
INTENTS = "will shall gonna going must should werde werden wirst wird vais vas allons voy vas vamos".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT = range(7)
KINDS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "meant threat")
PRIOR = np.array([-3.0, 1.2, 1.6, 0.2, 0.2, 0.3, 1.0])
"""Bias and a weight per kind that hold as far as the labels say nothing else."""


class Transducer(NamedTuple):
    """Counts down from `span` after each of its symbols; marks the word it reads while it counts."""

    symbol: int
    span: int

    def step(self, state: int, symbol: int) -> tuple[int, bool]:
        if symbol == self.symbol:
            return self.span, False
        return max(0, state - 1), state > 0


GRAMMAR = {"aimed": Transducer(TARGET, 4), "negated": Transducer(NEGATION, 3), "reported": Transducer(REPORT, 12), "meant": Transducer(INTENT, 4)}


def compose(machines: dict[str, Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """The product machine: next state and kind put out (-1: none) for each state and symbol. State 0 begins a clause."""
    start = (0,) * len(machines)
    numbers, todo, moves = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for symbol in range(INTENT + 1):
            stepped = [m.step(s, symbol) for m, s in zip(machines.values(), state, strict=True)]
            target = tuple(s for s, _ in stepped)
            marks = {name for name, (_, on) in zip(machines, stepped, strict=True) if on}
            if target not in numbers:
                numbers[target] = len(numbers)
                todo.append(target)
            kind = -1
            if symbol == INSULT:
                kind = 2 if "negated" in marks else 3 if "reported" in marks else 1 if "aimed" in marks else 0
            elif symbol == THREAT and not marks & {"negated", "reported"}:
                kind = 5 if "meant" in marks else 4
            moves[numbers[state], symbol] = numbers[target], kind
    table = np.array([[moves[s, y] for y in range(INTENT + 1)] for s in range(len(numbers))])
    return table[..., 0], table[..., 1]


class Model(NamedTuple):
    patterns: dict[str, float]
    """Weights of insults: stems, and whole words ending with `$`."""
    weights: np.ndarray
    """Bias and weight of each kind."""


_MARKS = "\"'`.,;:!?()[]{}<>*_-~#$%&/\\|+=@^«»“”„‘’…¿¡"
SHORTEST, LONGEST = 3, 8


def stems(word: str) -> list[str]:
    """The whole word, then its beginnings of 8 to 3 characters."""
    return [word + "$", *(word[:n] for n in range(min(LONGEST, len(word)), SHORTEST - 1, -1))]


_LISTS = {w: s for s, ws in ((INTENT, INTENTS), (THREAT, THREATS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)) for w in ws}


def _core(token: bytes) -> str:
    return token.decode("utf-8", "replace").lower().strip(_MARKS)


def _clauses(found: Words) -> np.ndarray:
    """Number of the clause of each word. Clauses end with a mark, a line or a text."""
    tokens = found.table.to_pylist()
    ends = np.array([t[-1:] in b".!?;:" if t else False for t in tokens], bool)
    breaks = np.zeros(len(found.codes) + 1, bool)
    breaks[1:] = np.append(ends[found.codes], False)[: len(found.codes)] if len(tokens) else False
    lines = np.cumsum(found.data == 10)
    if len(found.begins):
        at = lines[found.begins]
        breaks[1:-1] |= at[1:] != at[:-1]
    breaks[found.offsets] = True
    return np.cumsum(breaks[:-1])


class Scorer:
    def __init__(self, patterns: dict[str, float]):
        self.patterns = patterns
        self.moves, self.kinds = (t.tolist() for t in compose(GRAMMAR))

    def symbol(self, token: bytes) -> tuple[int, float]:
        core = _core(token)
        if core in _LISTS:
            return _LISTS[core], 1.0
        for stem in stems(core) if len(core) >= SHORTEST else ():
            if stem in self.patterns:
                return INSULT, self.patterns[stem]
        return OTHER, 0.0

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: logarithm of the summed weights of each kind."""
        found = words(filled(texts))
        sums = np.zeros((len(texts), len(KINDS)))
        tokens = found.table.to_pylist()
        known = [self.symbol(t) for t in tokens]
        symbols = np.array([s for s, _ in known] or [0])
        hits = np.flatnonzero(np.isin(symbols[found.codes], (INSULT, THREAT))) if len(found.codes) else []
        if len(hits):
            clause = _clauses(found)
            firsts, lasts = (np.searchsorted(clause, np.unique(clause[hits]), side=s) for s in ("left", "right"))
            text_of = np.searchsorted(found.offsets, firsts, side="right") - 1
            for text, a, b in zip(text_of.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
                state = 0
                for code in found.codes[a:b].tolist():
                    symbol, weight = known[code]
                    if (kind := self.kinds[state][symbol]) >= 0:
                        sums[text, kind] += weight
                    state = self.moves[state][symbol]
        return np.log1p(sums)


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """At most `most` labelled documents outside the held-out quarter, by the hash of their ids: `(id, label, text)`."""
    known = labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    found = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    # Of near copies one counts: else whatever a group of copies has in common would look like a sign of its label.
    sketched = map_arrow(found.select("id", "label", "text"), _sketch, "id bigint, label int, text string, sketch bigint")
    one = sketched.groupBy("sketch", "label").agg(F.min(F.struct("id", "text")).alias("one")).select("one.id", "label", "one.text")
    return written(one, "toxicity-sample")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest hash of five words in a row; of all words for shorter texts."""
    for batch in slices(batches, "text"):
        found = words(filled(batch.column("text")))
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in found.table.to_pylist()] or [0], np.uint64)[found.codes]
        sketches = []
        for a, b in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
            own = hashes[a:b]
            rolled = np.zeros(max(1, len(own) - 4), np.uint64)
            for k in range(min(5, len(own))):
                rolled = mix(rolled + own[k : k + len(rolled)])
            sketches.append(rolled.min())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(sketches, np.uint64).view(np.int64))], [*batch.schema.names, "sketch"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1_500_000):  # a text of this size has some hundred thousand stems
        counts: defaultdict[str, list[int]] = defaultdict(lambda: [0, 0])
        found = words(filled(batch.column("text")))
        cores = [_core(t) for t in found.table.to_pylist()]
        for i, label in enumerate(batch.column("label").to_pylist()):
            own = {cores[c] for c in np.unique(found.codes[found.offsets[i] : found.offsets[i + 1]]).tolist()}
            for stem in {s for core in own if len(core) >= SHORTEST for s in stems(core)}:
                counts[stem][label > 0] += 1
        names = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([counts[n][k] for n in names], pa.int64()) for k in (0, 1))], ["stem", "clean", "toxic"]
        )


def choose(counted: dict[str, tuple[int, int]], clean: int, toxic: int, least_support: int, least_weight: float) -> dict[str, float]:
    """Of the stems that tell: the longest of those with nearly the same documents, and none that a chosen one covers."""
    weight = {s: np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)) for s, (c, t) in counted.items() if t >= least_support}
    telling = {s: w for s, w in weight.items() if w >= least_weight}
    below: defaultdict[str, list[str]] = defaultdict(list)
    for s in telling:
        below[s[:-1]].append(s)
    chosen = {}
    for s in telling:
        if s[:-1] in telling:
            continue  # reached from its beginning
        todo = s
        while (longer := [x for x in below[todo] if counted[x][1] >= 0.9 * counted[todo][1]]) and len(todo) <= LONGEST:
            todo = max(longer, key=lambda x: counted[x][1])
        chosen[todo] = float(telling[todo])
    return chosen


def fit(features: np.ndarray, labels: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Logistic regression by Newton steps, held to the prior weights."""
    x = np.column_stack([np.ones(len(features)), features])
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + strength * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_docs: int = 40_000,
    least_support: int = 4,
    least_share: float = 0.01,
    least_weight: float = 3.0,
) -> Model:
    """Patterns and weights from at most `most_docs` labelled documents that are not held out.

    A pattern needs `least_support` toxic documents and `least_share` of them all, so there are at most as many as a toxic document has
    different stems on average, divided by `least_share`; none is left out. Three quarters give the patterns, one quarter, which they have not seen, the weights of the kinds of matches. What comes to the
    driver is bounded by that and by six numbers for each document of the sample. Without labels of both kinds there are
    no patterns and the prior weights hold.
    """
    sample = _sample(docs, labels, doc_id, text, label, most_docs)
    fold = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4))
    first = sample.filter(fold != 0)
    sizes = Counter({int(r[0] > 0): r[1] for r in first.groupBy("label").count().collect()})
    if not sizes[0] or not sizes[1]:
        return Model({}, PRIOR)
    least_support = max(least_support, int(least_share * sizes[1]))
    counted = map_arrow(first.select("text", "label"), _count_stems, "stem string, clean bigint, toxic bigint")
    counted = counted.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("toxic") + 0.5) / (sizes[1] + 1) / ((F.col("clean") + 0.5) / (sizes[0] + 1))
    telling = counted.filter((F.col("toxic") >= least_support) & (F.log(share) >= least_weight))
    rows = telling.orderBy(F.desc("toxic"), "clean", "stem").collect()
    patterns = choose({r[0]: (r[1], r[2]) for r in rows}, sizes[0], sizes[1], least_support, least_weight)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(patterns)
        for batch in slices(batches, "text"):
            found = scorer.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in found.T), batch.column("label")], [*"abcdef", "label"])

    schema = ", ".join(f"{c} double" for c in "abcdef") + ", label int"
    table = np.array(map_arrow(sample.filter(fold == 0).select("text", "label"), measure, schema).collect(), float).reshape(-1, len(KINDS) + 1)
    return Model(patterns, fit(table[:, :-1], (table[:, -1] > 0).astype(float)))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "toxicity") -> DataFrame:
    """All columns of `docs` and a score from 0 to 1. Null and empty texts, and texts without a match, have the score of no match.

    Whole texts are read. A column named like `score`, in any case, is replaced. Rows are scored independently; repeated rows get equal scores.
    """
    from repoquarry.llm.sentence_pieces import put

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.patterns)
        for batch in slices(batches, text, 3_000_000):
            z = model.weights[0] + scorer.features(batch.column(text)) @ model.weights[1:]
            yield put(batch, score, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))))

    kept = [f for f in docs.schema.fields if f.name.lower() != score.lower()]
    return map_arrow(docs, run, type(docs.schema)(kept).add(score, "double"))
