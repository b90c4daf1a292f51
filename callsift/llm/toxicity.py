"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.quality import held_out, labelled_sample
from callsift.llm.tables import stored

# Labelled rows that the weights are fitted on at most, chosen by a hash of the id.
SAMPLE_ROWS = 16_384

# A word joins the insults if at least MIN_TEXTS different toxic texts of the sample
# have it, between as many different pairs of words, and its log odds are at least MIN_ODDS.
MIN_TEXTS, MIN_ODDS = 5, 3.0
# Words that are learnt at most unless a caller says otherwise; they go to the driver and the tasks.
MOST_LEARNT = 4_096

# The lexicon of the grammar: class of each word.
LEXICON = {
    "insult": """
        idiot idiots moron morons clown clowns scum trash loser losers pathetic worthless disgusting stupid
        imbecile imbeciles cretin cretins jerk jerks bastard bastards bitch bitches asshole assholes fuck fucking
        fucker fuckers shit shitty dumbass jackass scumbag scumbags lowlife vermin degenerate degenerates subhuman
        parasite parasites filth filthy retard retarded dumb moronic idiotic brainless spineless repulsive
        despicable contemptible nitwit halfwit dimwit dipshit douchebag wanker twat prick
    """,
    "threat": """
        kill murder strangle stab shoot beat hurt destroy crush burn hang slaughter rape torture bury smash hunt
    """,
    "target": "you your yours yourself u ur him her them they he she these those all everyone tu vous du dich euch usted",
    "negation": "not no never none nor without nobody neither cannot isn't aren't wasn't don't doesn't didn't won't",
    "report": """
        said says say wrote writes called calls claimed claims quoted quotes reported reports alleged stated told
        according
    """,
}

_CLASS = {word: kind for kind, words in LEXICON.items() for word in words.split()}

# Tokens: words with inner apostrophes, ends of clauses, and quotation marks.
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[.!?;:\n]|[\"“”«»]")
# Words after which a negation no longer holds, and within which a target belongs to a hit.
NEGATION_REACH, TARGET_REACH = 3, 4

# The grammar reads symbols: classes of words, a further word, quotation marks and ends of clauses.
SYMBOLS = ("insult", "threat", "target", "negation", "report", "word", "quote", "end")
# Symbols that match; the transducers write marks behind them.
HITS = ("insult", "threat")


@dataclass(frozen=True)
class Transducer:
    """A weighted deterministic transducer as a table.

    ``arcs`` maps (state, symbol) to (next state, symbol written, weight).  A
    symbol that a state has no arc for is written as it is, and the state stays.
    Weights of a path are summed up.
    """

    start: object
    arcs: dict[tuple, tuple]

    def step(self, state: object, symbol: str) -> tuple[object, str, float]:
        return self.arcs.get((state, symbol)) or (state, symbol, 0.0)

    def states(self) -> list:
        return list(dict.fromkeys([self.start, *(s for s, _ in self.arcs), *(t for t, _, _ in self.arcs.values())]))

    def run(self, symbols: Sequence[str]) -> list[tuple[str, float]]:
        """(symbol written, weight of the arc) per symbol read."""
        state, written = self.start, []
        for symbol in symbols:
            state, out, weight = self.step(state, symbol)
            written.append((out, weight))
        return written


def compose(first: Transducer, second: Transducer, symbols: Sequence[str] = SYMBOLS) -> Transducer:
    """The transducer that writes what ``second`` writes on what ``first`` writes, over pairs of states.

    Only pairs that can be reached from the start are built; weights of both are added.
    """
    start = (first.start, second.start)
    arcs, waiting, seen = {}, [start], {start}
    while waiting:
        state = waiting.pop()
        for symbol in symbols:
            left, between, one = first.step(state[0], symbol)
            right, out, other = second.step(state[1], between)
            arcs[state, symbol] = ((left, right), out, one + other)
            if (left, right) not in seen:
                seen.add((left, right))
                waiting.append((left, right))
    return Transducer(start, arcs)


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """Marks hits among the ``reach`` words after a negation, to the end of its clause."""
    arcs = {}
    for left in range(reach + 1):
        arcs[left, "negation"] = (reach, "negation", 0.0)
        arcs[left, "end"] = (0, "end", 0.0)
        for symbol in ("target", "report", "word"):
            arcs[left, symbol] = (max(left - 1, 0), symbol, 0.0)
        for symbol in HITS:
            arcs[left, symbol] = (max(left - 1, 0), symbol + ("/negated" if left else ""), 0.0)
    return Transducer(0, arcs)


def reported_speech() -> Transducer:
    """Marks hits after a verb of speech in its clause, and between quotation marks; negated ones stay so."""
    arcs = {}
    for told in (False, True):
        for quoted in (False, True):
            state = (told, quoted)
            arcs[state, "quote"] = ((told, not quoted), "quote", 0.0)
            arcs[state, "report"] = ((True, quoted), "report", 0.0)
            arcs[state, "end"] = ((False, quoted), "end", 0.0)
            if told or quoted:
                for symbol in HITS:
                    arcs[state, symbol] = (state, f"{symbol}/reported", 0.0)
    return Transducer((False, False), arcs)


def targeted(reach: int = TARGET_REACH) -> Transducer:
    """Marks hits among the ``reach`` words after a target, to the end of its clause.

    Read from the end of a text it marks those before a target.
    """
    arcs = {}
    plain = [hit + mark for hit in HITS for mark in ("", "/negated", "/reported")]
    aimed = [symbol.replace(hit, f"{hit}+target") for symbol in plain for hit in HITS if symbol.startswith(hit)]
    for left in range(reach + 1):
        arcs[left, "target"] = (reach, "target", 0.0)
        arcs[left, "end"] = (0, "end", 0.0)
        for symbol in ("negation", "report", "word", *aimed):
            arcs[left, symbol] = (max(left - 1, 0), symbol, 0.0)
        for symbol, marked in zip(plain, aimed, strict=True):
            arcs[left, symbol] = (max(left - 1, 0), marked if left else symbol, 0.0)
    return Transducer(0, arcs)


def accepting(weights: dict[str, float]) -> Transducer:
    """Gives each pattern its weight; threats without a target are no pattern, so it writes a word for them."""
    dropped = [f"threat{mark}" for mark in ("", "/negated", "/reported")]
    arcs = {(0, pattern): (0, pattern, weight) for pattern, weight in weights.items()}
    return Transducer(0, arcs | {(0, symbol): (0, "word", 0.0) for symbol in dropped})


# Weights of the accepted patterns before any label is seen; fitted weights are drawn to them.
PRIOR = {
    "insult": 3.0, "insult+target": 4.0, "threat+target": 3.0,
    "insult/negated": 1.0, "insult+target/negated": 1.5, "threat+target/negated": 0.5,
    "insult/reported": 1.5, "insult+target/reported": 2.0, "threat+target/reported": 1.0,
}
PATTERNS = list(PRIOR)


@lru_cache(maxsize=1)
def grammar_passes() -> tuple[Transducer, Transducer]:
    """The grammar as two machines: one reads a text forwards, the other what it wrote backwards.

    Targets may stand on both sides of a hit, so one pass in one direction cannot
    decide; negation, reported speech and targets before a hit are composed into
    the first, targets behind it and the weights of the patterns into the second.
    """
    forwards = compose(compose(negation(), reported_speech()), targeted())
    written = list(dict.fromkeys([*SYMBOLS, *(out for _, out, _ in forwards.arcs.values())]))
    return forwards, compose(targeted(), accepting(PRIOR), written)


def symbols(text: str, learnt: frozenset[str] = frozenset()) -> tuple[list[str], list[str]]:
    """The tokens of a text and the symbols the grammar reads for them."""
    tokens = _TOKEN.findall(text)
    read = []
    for token in tokens:
        if len(token) == 1 and not token.isalnum():
            read.append("end" if token in ".!?;:\n" else "quote")
        else:
            read.append(_CLASS.get(token) or ("insult" if token in learnt else "word"))
    return tokens, read


def clauses(text: str, learnt: frozenset[str] = frozenset()) -> list[tuple[str, float, list[tuple[str, str]]]]:
    """(clause, weight, its (word, pattern) matches) of each clause that the grammar accepts.

    The weight of a clause is that of its path before any label is seen.
    """
    tokens, read = symbols(text, learnt)
    forwards, backwards = grammar_passes()
    written = backwards.run([out for out, _ in forwards.run(read)][::-1])[::-1]
    found, start = [], 0
    for at in [*(i for i, symbol in enumerate(read) if symbol == "end"), len(read)]:
        path = [(tokens[i], *written[i]) for i in range(start, at)]
        matches = [(word, out) for word, out, _ in path if out in PRIOR]
        if matches:
            found.append((" ".join(tokens[start:at]), sum(weight for *_, weight in path), matches))
        start = at + 1
    return found


def hits(text: str, learnt: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """(word, pattern) of each insult or threat in the clauses that the grammar accepts; threats need a target."""
    return [match for _, _, matches in clauses(text, learnt) for match in matches]


@lru_cache(maxsize=4)
def _finder(learnt: frozenset[str]) -> ahocorasick.Automaton:
    finder = ahocorasick.Automaton()
    for word, kind in _CLASS.items():
        if kind in ("insult", "threat"):
            finder.add_word(word, len(word))
    for word in learnt:
        finder.add_word(word, len(word))
    finder.make_automaton()
    return finder


def matched(text: str, learnt: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """The hits of a text; texts without any insult or threat word cost one scan."""
    lower = text.lower()
    for end, size in _finder(learnt).iter(lower):
        start = end - size + 1
        if not (start and lower[start - 1].isalnum()) and not lower[end + 1 : end + 2].isalnum():
            return hits(lower, learnt)
    return []


class Grammar:
    """Weights of the patterns and reliabilities of the words."""

    def __init__(self):
        self.bias, self.weights, self.trust, self.learnt = -3.0, dict(PRIOR), {}, frozenset()

    def vector(self, found: list[tuple[str, str]]) -> np.ndarray:
        sums = Counter()
        for word, pattern in found:
            sums[pattern] += self.trust.get(word, 1.0)
        return np.log1p([sums[p] for p in PATTERNS])

    def fit(self, rows: list[list[tuple[str, str]]], labels: np.ndarray) -> Grammar:
        """Trust of a word: smoothed share of toxic texts among those with it.

        Pattern weights: logistic regression with a Gaussian prior around
        :data:`PRIOR`.  Without labels the prior stands.
        """
        labels = np.asarray(labels, dtype=float)
        seen, toxic = Counter(), Counter()
        for row, label in zip(rows, labels, strict=True):
            words = {word for word, _ in row}
            seen.update(words)
            toxic.update(words if label else ())
        # A word of the built-in lexicon starts with full trust, a learnt one with none.
        for word in seen:
            known = 2.0 if word in _CLASS else 0.0
            self.trust[word] = (toxic[word] + known) / (seen[word] + max(known, 3.0))
        if not len(rows):
            return self
        x = np.column_stack([np.ones(len(rows)), np.array([self.vector(r) for r in rows])])
        prior = np.array([-3.0, *PRIOR.values()])
        beta, ridge = prior.copy(), np.array([1e-3, *[0.1] * len(PATTERNS)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            gradient = x.T @ (p - labels) + ridge * (beta - prior)
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(hessian, gradient)
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            beta -= step
            if np.abs(step).max() < 1e-8:
                break
        self.bias, self.weights = float(beta[0]), dict(zip(PATTERNS, beta[1:].tolist(), strict=True))
        return self

    def score(self, found: list[tuple[str, str]]) -> float:
        total = self.bias + float(self.vector(found) @ np.array([self.weights[p] for p in PATTERNS]))
        return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of each text, with the words around its first place."""
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
            found = _TOKEN.findall((text.as_py() or "").lower())
            first: dict[str, str] = {}
            for before, word, after in zip(["", *found], found, [*found[1:], ""], strict=False):
                first.setdefault(word, f"{before} {after}")
            marks = pa.array([label.as_py()] * len(first), pa.int32())
            columns = [pa.array(list(first), pa.string()), pa.array(list(first.values()), pa.string()), marks]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "around", "label"])


def learn_insults(sample: DataFrame, most: int = MOST_LEARNT) -> frozenset[str]:
    """Words that mark toxic texts of the sample, at most ``most``, the surest first.

    Copies of a text count once, as toxic if one of them is, and near copies
    repeat a word between the same words, so the words of one much-copied text do
    not pass.
    """
    texts = sample.groupBy("text").agg(F.max("label").alias("label"))
    both = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counted = (
        texts.select("text", "label").mapInArrow(_words, "word string, around string, label int")
        .groupBy("word", "around").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
        .groupBy("word").agg(
            F.sum("toxic").alias("toxic"),
            F.sum("clean").alias("clean"),
            F.count(F.when(F.col("toxic") > 0, 1)).alias("contexts"),
        )
    )
    shares = [(F.col(c) + 0.5) / F.lit(both.get(y, 0) + 1.0) for c, y in (("toxic", 1), ("clean", 0))]
    odds = F.log(shares[0] / shares[1])
    sure = counted.where(
        (F.col("toxic") >= MIN_TEXTS) & (F.col("contexts") >= MIN_TEXTS) & (odds >= MIN_ODDS)
        & (F.length("word") >= 3)
    )
    top = sure.orderBy(F.desc(odds), "word").limit(most)
    return frozenset(r["word"] for r in top.collect())


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, most_learnt: int = MOST_LEARNT
) -> Grammar:
    """Fit on a bounded sample; only the hits of its texts go to the driver, counted by pattern and word."""
    sample = stored(labelled_sample(docs, labels, label, rows), "toxic-sample")
    learnt = learn_insults(sample, most_learnt)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(Counter(matched(t.as_py() or "", learnt)).items()) for t in batch.column("text")]
            lists = pa.array(
                [[{"word": w, "pattern": p, "n": n} for (w, p), n in row] for row in found],
                pa.list_(pa.struct([("word", pa.string()), ("pattern", pa.string()), ("n", pa.int64())])),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), lists], names=["doc_id", "label", "hits"]
            )

    schema = "doc_id long, label int, hits array<struct<word string, pattern string, n long>>"
    table = sorted(sample.mapInArrow(extract, schema).toArrow().to_pylist(), key=lambda r: r["doc_id"])
    lists = [[(h["word"], h["pattern"]) for h in r["hits"] for _ in range(h["n"])] for r in table]
    grammar = Grammar()
    grammar.learnt = learnt
    return grammar.fit(lists, np.array([r["label"] for r in table], dtype=float))


def toxicity_scores(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, predicted, n_hits`` of each row, from its whole text; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matched(t.as_py() or "", grammar.learnt) for t in batch.column("text")]
            scores = np.array([grammar.score(f) for f in found], dtype=float)
            arrays = [batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            arrays.append(pa.array([len(f) for f in found], pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "predicted", "n_hits"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int, n_hits int")


def classify_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score all documents for toxicity with weights learnt from the labels.

    The lexicon of the grammar is English; insults of other languages are learnt
    from the labels (:func:`learn_insults`), as are the weights.  Rows whose
    ``crc32(doc_id)`` modulo 5 is 0 are held out of the fit.  Returns
    one row per input row: ``doc_id, held_out, score, predicted, n_hits``.
    Documents without a hit, empty and null texts among them, get the score of
    the bias.  Documents with a null id are scored and not held out; labels with
    nulls or other values are not learnt from, and of repeated labels of one id
    the larger counts.  Texts of any length are scored as a whole; repeated ids
    are scored each, and learnt from once.  An empty table gives an empty result.
    Other columns are ignored.
    """
    grammar = fit_toxicity(docs, labels.where(~held_out("doc_id", 5, 0)), rows=rows)
    scored = toxicity_scores(docs, grammar)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "n_hits")
