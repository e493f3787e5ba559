"""Toxicity scores from a learned lexicon: Levenshtein automata over a trie, and the context of every match.

Learning reads a bounded sample of labelled documents. Words, and stems under which many different words stand, that
occur far more in toxic documents than chance allows form the lexicon. It is kept as a trie; words of a text are run
through the product of the trie with Levenshtein automata, determinised as it is used, so that a misspelled term is
met in one pass over its letters and almost every other word dies within its first few. A match inside quotation
marks, or beside none of its kind, is counted apart from one in the open: what each kind of match says is then fitted
by a logistic regression on the same sample.
"""

import math
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplewatch.llm.common import documents, slices, stored, texts_of

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
STEM_LENGTHS = range(4, 13)
WORDS_OF_STEM = 5
WORD = re.compile(r"\w+")
#: Opening and closing quotation marks.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}
NEAR = 60
_FEATURES = 12


class Automaton:
    """Accepts lexicon words within ``edits`` letters, and every word that goes on after a stem."""

    def __init__(self, words: list[str], stems: list[str], edits: int = 1, shortest: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.word = [-1]  # edits allowed when a word ends here
        self.stem = [False]
        self.edits, self.exact = edits, frozenset(words)
        for text in words:
            self.word[self._node(text)] = edits if len(text) >= shortest else 0
        for text in stems:
            self.stem[self._node(text)] = True
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.verdict: list[int] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _node(self, text: str) -> int:
        node = 0
        for ch in text:
            if ch not in self.children[node]:
                self.children[node][ch] = len(self.children)
                self.children.append({})
                self.word.append(-1)
                self.stem.append(False)
            node = self.children[node][ch]
        return node

    def _closed(self, pairs: set) -> frozenset:
        """With the places that leaving out letters of the lexicon reaches."""
        todo = list(pairs)
        while todo:
            node, used = todo.pop()
            if used < self.edits:
                for child in self.children[node].values():
                    if (child, used + 1) not in pairs:
                        pairs.add((child, used + 1))
                        todo.append((child, used + 1))
        return frozenset(pairs)

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.step.append({})
            exact = any(used == 0 and self.word[node] >= 0 for node, used in pairs)
            close = any(used <= self.word[node] for node, used in pairs)
            self.verdict.append(1 if exact else 2 if close else 0)
        return self.states[pairs]

    def _next(self, state: int, ch: str) -> int:
        """-1: nothing can match any more; -2: a stem is complete."""
        pairs = set()
        for node, used in self.sets[state]:
            child = self.children[node].get(ch)
            if child is not None:
                if used == 0 and self.stem[child]:
                    return -2
                pairs.add((child, used))
            if used < self.edits:
                pairs.add((node, used + 1))
                pairs.update((other, used + 1) for other in self.children[node].values())
        return self._state(self._closed(pairs)) if pairs else -1

    def match(self, word: str) -> int:
        """1: in the lexicon, 2: a misspelled lexicon word, 3: longer than a stem it begins with, 0: none of these."""
        state = self.start
        for at, ch in enumerate(word, 1):
            known = self.step[state]
            after = known.get(ch)
            if after is None:
                after = known[ch] = self._next(state, ch)
            if after == -2 and at == len(word) or after == -1:
                return int(word in self.exact)
            if after == -2:
                return 1 if word in self.exact else 3
            state = after
        return self.verdict[state]


class Scorer:
    """Words to matches, matches to features, features to a score."""

    def __init__(self, words: list[str], stems: list[str], weights=None):
        self.words, self.stems = words, stems
        self.weights = np.zeros(_FEATURES) if weights is None else np.asarray(weights, float)
        self.automaton, self.memo = None, {}

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def features(self, text: str) -> np.ndarray:
        """Bias; then of each kind of match presence and log count; company, distinct stemmed words and their rate."""
        if self.automaton is None:
            self.automaton = Automaton(self.words, self.stems)
        low, memo = text.lower(), self.memo
        if len(memo) > 200_000:  # a cache only
            memo.clear()
        said = WORD.findall(low)
        found = False
        for word in set(said):
            kind = memo.get(word)
            if kind is None:
                kind = memo[word] = self.automaton.match(word)
            found = found or kind > 0
        out = np.zeros(_FEATURES)
        out[0] = 1.0
        if found:
            self._context(low, len(said), out)
        return out

    def _context(self, low: str, n_words: int, out: np.ndarray) -> None:
        quoted = quoted_ranges(low)
        counts = [0, 0, 0, 0]  # open, misspelled, stemmed, quoted
        company, last, stemmed = 0, -(10**9), set()
        for m in WORD.finditer(low):
            kind = self.memo[m[0]]
            if not kind:
                continue
            if any(a < m.start() and m.end() <= b for a, b in quoted):
                counts[3] += 1
                continue
            counts[kind - 1] += 1
            if kind == 3:
                stemmed.add(m[0])
            company += m.start() - last <= NEAR
            last = m.end()
        for k, n in enumerate(counts):
            out[1 + 2 * k], out[2 + 2 * k] = float(n > 0), math.log1p(n)
        out[9] = math.log1p(company)
        out[10] = math.log1p(len(stemmed))
        out[11] = math.log1p(1000 * counts[2] / n_words)

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + math.exp(-float(np.clip(self.features(text) @ self.weights, -30, 30))))


def quoted_ranges(text: str, longest: int = 300) -> list[tuple[int, int]]:
    """Ranges between quotation marks that close within one line and ``longest`` characters."""
    out, at = [], 0
    opening = re.compile("[" + "".join(QUOTES) + "]")
    while m := opening.search(text, at):
        close = text.find(QUOTES[m[0]], m.end(), m.end() + longest)
        if close < 0 or "\n" in text[m.end() : close]:
            at = m.end()
        else:
            out.append((m.start(), close))
            at = close + 1
    return out


def held_out(doc_id: str):
    """The rows that learning never reads: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _terms(text: str) -> set:
    """Distinct words (marked by a final space) and stems of a text."""
    out = set()
    for word in set(WORD.findall(text.lower())):
        out.add(word + " ")
        out.update(word[:n] for n in STEM_LENGTHS if n < len(word))
    return out


def _term_counts(rows: DataFrame, among: frozenset | None) -> DataFrame:
    """(term, n documents), summed in each task first; only of the terms ``among`` where that is given."""

    def count(batches):
        found: dict[str, int] = {}
        for batch in batches:
            for text in texts_of(batch):
                terms = _terms(text)
                for term in terms if among is None else terms & among:
                    found[term] = found.get(term, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"]
        )

    return rows.select("doc_id", "text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _contexts(rows: DataFrame, terms: frozenset) -> dict[str, int]:
    """Behind how many different words each word stands, and under each stem: in copies of one text it is few."""

    def pairs(batches):
        found = set()
        for batch in batches:
            for text in texts_of(batch):
                before = ""
                for word in WORD.findall(text.lower()):
                    if word + " " in terms:
                        found.add((word + " ", zlib.crc32(before.encode()) % 1024))
                    stems = (word[:n] for n in STEM_LENGTHS if n < len(word))
                    found.update((t, zlib.crc32(word.encode()) % 1024) for t in stems if t in terms)
                    before = word
        terms_found, behind = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms_found, pa.string()), pa.array(behind, pa.int64())], names=["term", "behind"]
        )

    spread = rows.select("doc_id", "text").mapInArrow(pairs, "term string, behind long").distinct()
    return {r["term"]: r["count"] for r in spread.groupBy("term").count().collect()}


def _lexicon(toxic: dict[str, int], clean: dict[str, int], spread: dict[str, int]) -> tuple[list[str], list[str]]:
    """Words and stems that are toxic beyond chance; stems only where several different words stand under them."""
    good = _beyond(toxic, clean)
    words = [t[:-1] for t in good if t.endswith(" ")]
    commonest: dict[str, int] = {}  # of the words under each stem
    for t, n in toxic.items():
        if t.endswith(" "):
            for size in STEM_LENGTHS:
                if size < len(t) - 1:
                    commonest[t[:size]] = max(commonest.get(t[:size], 0), n)
    open_stems = {
        t
        for t in good
        if not t.endswith(" ") and spread.get(t, 0) >= WORDS_OF_STEM and 1.5 * commonest.get(t, 0) <= toxic[t]
    }
    stems = []
    for t in sorted(open_stems, key=lambda t: (len(t), t)):
        if any(t.startswith(s) for s in stems):
            continue
        while True:  # the longest stem that still stands in nearly all documents of this one
            longer = [u for u in open_stems if len(u) == len(t) + 1 and u.startswith(t)]
            best = max(longer, key=lambda u: (toxic[u], u), default=None)
            if best is None or toxic[best] < 0.95 * toxic[t]:
                break
            t = best
        stems.append(t)
    words = [w for w in words if not any(w.startswith(s) for s in stems)]
    return sorted(words), sorted(set(stems))


def _beyond(toxic: dict[str, int], clean: dict[str, int]) -> set:
    """Terms that the toxic documents hold far more often than the clean ones."""
    return {t for t, n in toxic.items() if n >= (4 if t.endswith(" ") else 1.5) * clean.get(t, 0)}


def _beyond_clean() -> Column:
    """The same of rows with ``term``, ``n`` and ``n_clean``."""
    return F.col("n") >= F.when(F.col("term").endswith(" "), 4.0).otherwise(1.5) * F.col("n_clean")


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the bias is not penalised."""
    w, held = np.zeros(x.shape[1]), np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + held, x.T @ (y - p) - held @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Learn a scorer from at most about ``train_rows`` labelled documents outside the held-out third.

    Rows are taken by a hash of their id, so the sample is the same in every run. Several labels of one document
    count as toxic if any does; null labels are no labels. Without a toxic or a clean document every text scores the
    share of toxic documents (0 without any labels). Every term of the sample counts that stands in enough toxic
    documents (more than chance explains, and at least 0.5 % of them) and far more often than in clean ones.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.dropna().filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > train_rows:
        share = int(train_rows / n * 2**31)
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < share)
    # No more rows than the documented bound, give or take the spread of a hash.
    sample = stored(documents(docs).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]), "labelled")
    toxic, clean = sample.filter("toxic = 1"), sample.filter("toxic = 0")
    positives, negatives = toxic.count(), clean.count()
    if not positives or not negatives:
        bias = np.zeros(_FEATURES)
        bias[0] = 30.0 if positives else -30.0
        return Scorer([], [], bias)
    counted = _term_counts(toxic, None)
    # A term is kept if so many toxic documents would not hold it by chance, whatever the number of terms.
    terms = max(1, counted.count())
    base = positives / (positives + negatives)
    least = max(3, math.ceil(math.log(terms) / -math.log(min(0.9, base))), math.ceil(0.005 * positives))
    against = _term_counts(clean, None).withColumnRenamed("n", "n_clean")
    often = counted.filter(F.col("n") >= least).join(against, "term", "left").fillna(0, ["n_clean"])
    found = often.filter(_beyond_clean()).collect()  # the bounded sample bounds them
    in_toxic = {r["term"]: r["n"] for r in found}
    in_clean = {r["term"]: r["n_clean"] for r in found}
    spread = _contexts(toxic, frozenset(in_toxic))
    in_toxic = {t: n for t, n in in_toxic.items() if spread.get(t, 0) >= max(3, least // 2)}
    words, stems = _lexicon(in_toxic, in_clean, spread)
    ranked = sorted(words, key=lambda w: (-in_toxic[w + " "], w))
    scorer = Scorer(ranked, stems)
    rows = _features(sample, scorer).collect()  # a few numbers for each row of the bounded sample
    x = np.array([r["features"] for r in rows])
    scorer.weights = _fit(x, np.array([float(r["toxic"]) for r in rows]))
    return scorer


def _features(sample: DataFrame, scorer: Scorer) -> DataFrame:
    def run(batches):
        for batch in batches:
            made = [scorer.features(t).tolist() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(made, pa.list_(pa.float64()))], names=["toxic", "features"]
            )

    return sample.select("doc_id", "text", "toxic").mapInArrow(run, "toxic int, features array<double>")


def _scores(docs: DataFrame, scorer: Scorer, add):
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scorer))  # a lexicon of the bounded sample

    def run(batches):
        own = pickle.loads(packed.value)
        for batch in slices(batches):
            yield add(batch, np.array([own.score(t) for t in texts_of(batch)]))

    return run


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score (0 to 1) of every row; a null text scores like an empty one. Other columns are ignored."""

    def add(batch, scores):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(_scores(docs, scorer, add), "doc_id long, score double")


def accepted(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, whose score stays under ``threshold``."""
    return docs.mapInArrow(_scores(docs, scorer, lambda b, s: b.filter(pa.array(s < threshold))), docs.schema)
