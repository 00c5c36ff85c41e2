"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

Fitting, on at most ``FIT_ROWS`` labelled rows: words and word beginnings that toxic
documents share and clean ones mostly lack become the lexicon, each weighted by its log
odds. Near copies count once (by the least hash of three words in a row), so a copied
document teaches no words of its own.

Scoring: the lexicon is a trie; each term of five letters or more, word or beginning, also
brings the Levenshtein automaton of one edit, of two from eight letters. Intersected, they are one
deterministic automaton over word characters, built on the driver and run over all
different words of a batch at once. Words that it accepts with an edit but that clean
documents of the sample use are taken out. Each accepted word is then looked at in its
window of text: between the two marks of one quotation it counts as quoted; apostrophes in
words are no marks. A logistic model over four
sums of weights (exact or misspelled, always quoted or not) and the length gives the score.

Labels, language, source and id are inputs of no score. Null and empty texts hold nothing
and get the model's lowest score. Texts are read whole. Rows without a label, and labels
of null or of both kinds for one id (the larger counts), are allowed; with no toxic
label at all the lexicon is empty. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .bpe import map_texts
from .minhash import mix

#: Most labelled rows that the lexicon and the model are fitted on.
FIT_ROWS = 20_000
#: A term is in so many toxic documents of the sample, and in this share of them, at least,
LEAST_DOCS, LEAST_SHARE = 3, 0.012
#: this sure that it isn't there by chance (natural logarithm), and toxic in this share of its documents.
LEAST_NATS, LEAST_PRECISION = 9.0, 0.75
STEM_LENGTHS = range(4, 8)
ROUNDS = 4
#: Characters on either side of a term that may hold its quotation marks.
WINDOW_CHARS = 48
THRESHOLD = 0.7

#: Quotation marks, and the marks that each of them closes.
CLOSES = {'"': '"', "”": "“„”", "“": "„", "»": "«", "«": "»", "›": "‹", "‹": "›", "’": "‘", "'": "'"}
OPENING = "\"“„”«»‹›‘'"
MARK = re.compile("[\"“„”«»‹›‘’']")
WORD = re.compile(r"\w+")
FEATURES = ("exact", "exact_quoted", "fuzzy", "fuzzy_quoted", "length")
#: Bias and weights before any label is seen; fitting is drawn towards them.
PRIOR = np.array([-2.5, 4.0, 1.0, 1.0, 0.2, 0.0])


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]
    #: Words that are accepted with an edit though clean documents use them.
    innocent: frozenset[str] = frozenset()

    def weight(self, word: str) -> float:
        """Log odds of a word in the lexicon; of its longest beginning that is there; 3 for a misspelled one."""
        if word in self.words:
            return self.words[word]
        return next((self.stems[word[:k]] for k in reversed(STEM_LENGTHS) if word[:k] in self.stems), 3.0)

    def exact(self, words: set[str]) -> float:
        """The log odds of all ``words`` that are in the lexicon as they are."""
        return sum(self.weight(w) for w in words if w in self.words or any(w[:k] in self.stems for k in STEM_LENGTHS))


class Automaton:
    """The trie of a lexicon intersected with its terms' Levenshtein automata, made deterministic.

    With ``stem_edits``, beginnings have edits too: any word that starts with a misspelled beginning is accepted.
    """

    def __init__(self, lexicon: Lexicon, stem_edits: bool = False):
        terms = [(w, edits(w), False) for w in lexicon.words] + [(s, edits(s) if stem_edits else 0, True) for s in lexicon.stems]
        letters = sorted({c for t, _, _ in terms for c in t})
        self.classes = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other character
        trie, ends = self._trie(terms)
        tail = len(trie)  # what follows a beginning
        trie.append({})
        ends[tail] = (9, True)

        def closed(positions: dict[tuple[int, int], None]) -> frozenset:
            """With letters of terms left out; only the fewest edits at each node are kept."""
            best: dict[int, int] = {}
            todo = list(positions)
            while todo:
                node, e = todo.pop()
                if best.get(node, 9) <= e:
                    continue
                best[node] = e
                if node in stars and e <= stars[node]:
                    todo.append((tail, e))
                todo += [(child, e + 1) for child in trie[node].values() if e < reach[child]]
            # after a beginning any letters do, so only what needs fewer edits is followed besides
            return frozenset((node, e) for node, e in best.items() if node == tail or e < best.get(tail, 9))

        reach = [0] * len(trie)  # edits that a term through the node may have
        for t, k, _ in terms:
            node = 0
            for c in t:
                node = trie[node][c]
                reach[node] = max(reach[node], k)
            reach[0] = max(reach[0], k)
        stars = {n: k for n, (k, star) in ends.items() if star and n != tail}
        start = closed({(0, 0): None})
        ids, table, self.accepts = {start: 1, frozenset(): 0}, {0: [0] * (len(letters) + 1)}, {}
        todo = [start]
        while todo:
            state = todo.pop()
            row = []
            for c in [None, *letters]:
                following: dict[tuple[int, int], None] = {}
                for node, e in state:
                    if node == tail:
                        following[node, e] = None
                    if c in trie[node]:
                        following[trie[node][c], e] = None
                    if e < reach[node] or not node and e < reach[0]:
                        following[node, e + 1] = None  # a letter too many
                    for child in trie[node].values():
                        if e < reach[child]:
                            following[child, e + 1] = None  # another letter
                nxt = closed(following)
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                row.append(ids[nxt])
            table[ids[state]] = row
        self.table = np.array([table[i] for i in range(len(ids))], np.int32)
        self.cost = np.full(len(ids), 9, np.int8)  # fewest edits of an accepted word
        for state, i in ids.items():
            self.cost[i] = min((e for node, e in state if node in ends and e <= (ends[node][0])), default=9)

    @staticmethod
    def _trie(terms: list[tuple[str, int, bool]]) -> tuple[list[dict[str, int]], dict[int, tuple[int, bool]]]:
        trie: list[dict[str, int]] = [{}]
        ends: dict[int, tuple[int, bool]] = {}
        for t, k, star in terms:
            node = 0
            for c in t:
                if c not in trie[node]:
                    trie.append({})
                    trie[node][c] = len(trie) - 1
                node = trie[node][c]
            ends[node] = (k, star or ends.get(node, (0, False))[1])
        return trie, ends

    def find(self, words: list[str]) -> dict[str, int]:
        """Edits of each of ``words`` that is accepted."""
        if not words:
            return {}
        points = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(points == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        lookup = np.zeros(max([0, *map(ord, self.classes)]) + 2, np.int32)
        for c, i in self.classes.items():
            lookup[ord(c)] = i
        kinds = lookup[np.minimum(points, len(lookup) - 1)]
        state = np.ones(len(words), np.int32)
        live = np.arange(len(words))
        at = starts.copy()
        while len(live):
            live = live[(at[live] < ends[live]) & (state[live] > 0)]
            state[live] = self.table[state[live], kinds[at[live]]]
            at[live] += 1
        cost = np.where(at >= ends, self.cost[state], 9)
        hits = np.flatnonzero(cost < 9)
        return {words[i]: int(cost[i]) for i in hits}


def quotations(text: str) -> list[tuple[int, int]]:
    """Places of the two marks of each quotation in ``text``, by the opening one.

    A mark closes the nearest one that is open and that it fits, else it opens. An apostrophe between letters is no mark,
    one after a letter opens nothing, and a mark that isn't closed within two windows isn't one of a pair.
    """
    found, still_open = [], []
    for m in MARK.finditer(text):
        at, mark = m.start(), m[0]
        after_word, before_word = text[at - 1 : at].isalnum(), text[at + 1 : at + 2].isalnum()
        if mark in "'’‘" and after_word and before_word:
            continue
        still_open = [o for o in still_open if at - o <= 2 * WINDOW_CHARS + 64]
        fits = CLOSES.get(mark, "")
        # a single mark may not close after a space: it would be an apostrophe before a word
        k = next((k for k in reversed(range(len(still_open))) if text[still_open[k]] in fits), -1) if mark not in "'’" or not text[at - 1 : at].isspace() else -1
        if k >= 0:
            found.append((still_open[k], at))
            del still_open[k:]
        elif mark in OPENING and not after_word:
            still_open.append(at)
    return sorted(found)


def quoted(text: str, start: int, end: int, pairs: list[tuple[int, int]] | None = None) -> bool:
    """Whether both marks of a quotation around the term stand in its window; ``pairs`` are the text's quotations."""
    pairs = quotations(text) if pairs is None else pairs
    near = pairs[bisect_left(pairs, (start - WINDOW_CHARS, 0)) : bisect_left(pairs, (start, 0))]
    return any(end <= b <= end + WINDOW_CHARS for _, b in near)


def features(texts: list[str], automaton: Automaton, lexicon: Lexicon) -> tuple[np.ndarray, list[set[str]]]:
    """A row of FEATURES for each text, and the words in it accepted with an edit."""
    lowered = [t.lower() for t in texts]
    words = [set(WORD.findall(t)) for t in lowered]
    found = automaton.find(sorted(set().union(*words)))
    out, misspelled = np.zeros((len(texts), len(FEATURES))), []
    for i, (text, own) in enumerate(zip(lowered, words, strict=True)):
        hits = {w: found[w] for w in own & found.keys() if not found[w] or w not in lexicon.innocent}
        misspelled.append({w for w, e in hits.items() if e})
        if hits:
            pairs = quotations(text)
            plain = {m[0] for m in WORD.finditer(text) if m[0] in hits and not quoted(text, m.start(), m.end(), pairs)}
            for w, e in sorted(hits.items()):
                out[i, 2 * (e > 0) + (w not in plain)] += lexicon.weight(w) / 5
        out[i, -1] = log1p(len(own)) / 10
    return out, misspelled


@dataclass
class Model:
    lexicon: Lexicon
    automaton: Automaton
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + rows @ self.weights[1:], -30, 30)))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 2.0) -> np.ndarray:
    """Newton's method, drawn towards ``prior``."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (p - y) + pull * (w - prior))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sketch_of(words: list[str]) -> int:
    """The least hash of three words in a row: near copies often share it, other documents never do."""
    h = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    if len(h) < 3:
        return int(h.sum())
    return int(mix(h[:-2] + (h[1:-1] << np.uint64(13)) + (h[2:] << np.uint64(31))).min() >> np.uint64(1))


def term_rows(wanted: frozenset[str] | None):
    """Rows (term, sketch, toxic) for a document's words and word beginnings (with a ``*``), or for those of them that are ``wanted``."""
    stems = {k: frozenset(t[:-1] for t in wanted or () if t.endswith("*") and len(t) == k + 1) for k in STEM_LENGTHS}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                listed = WORD.findall(text.lower())
                words = set(listed)
                if wanted is None:
                    words = {w for w in words if not w.isdigit() and len(w) < 40}
                    terms = words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k}
                else:
                    terms = words & wanted
                    for k in STEM_LENGTHS:
                        if stems[k]:
                            terms |= {t + "*" for t in {w[:k] for w in words if len(w) > k} & stems[k]}
                if terms:
                    sketch = sketch_of(listed)
                    rows += [(t, sketch, toxic) for t in terms]
            yield pd.DataFrame(rows, columns=["term", "sketch", "toxic"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled rows that aren't held out, the same ones in every run."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    return docs.select("doc_id", store.text_or_empty().alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")


def learn_terms(sample: DataFrame, found: dict[str, tuple[int, float, float]]) -> None:
    """Adds to ``found`` the terms (beginnings end in ``*``) that tell toxic rows of ``sample`` from clean ones: documents, certainty, log odds."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if n.get(1, 0) < LEAST_DOCS:
        return
    least = max(LEAST_DOCS, LEAST_SHARE * n[1])
    schema = "term string, sketch long, toxic int"
    often = sample.where("toxic = 1").mapInPandas(term_rows(None), schema).groupBy("term").agg(F.countDistinct("sketch").alias("n")).where(F.col("n") >= least)
    # a term is in LEAST_SHARE of the sample's toxic rows at least, so the list has a bound
    wanted = frozenset(r["term"] for r in often.select("term").collect())
    counted = sample.mapInPandas(term_rows(wanted), schema).groupBy("term").agg(
        F.countDistinct(F.when(F.col("toxic") == 1, F.col("sketch"))).alias("bad"), F.countDistinct(F.when(F.col("toxic") == 0, F.col("sketch"))).alias("good")
    )
    share = n[1] / sum(n.values())
    for r in counted.collect():
        bad, good = r["bad"], r["good"]
        rate = bad / (bad + good)
        if share == 1:
            nats = LEAST_NATS
        elif rate > share:
            nats = bad * log(rate / share) + (good * log((1 - rate) / (1 - share)) if good else 0.0)
        else:
            continue
        if rate >= LEAST_PRECISION and nats >= LEAST_NATS and r["term"] not in found:
            odds = log((bad + 0.5) / (n[1] + 1)) - log((good + 0.5) / (n.get(0, 0) + 1))
            found[r["term"]] = (bad, nats, odds)


def chosen(found: dict[str, tuple[int, float, float]]) -> Lexicon:
    """All words found, and of beginnings that begin one another the surest."""
    stems: dict[str, float] = {}
    words = {w: f for w, f in found.items() if not w.endswith("*")}
    for t, (bad, _, odds) in sorted(((t[:-1], f) for t, f in found.items() if t.endswith("*")), key=lambda x: (-x[1][1], x[0])):
        # a beginning stands for many words; where one word makes it up, the word is the term
        top = max((f[0] for w, f in words.items() if w.startswith(t)), default=0)
        if top < 0.8 * bad and not any(t.startswith(s) or s.startswith(t) for s in stems):
            stems[t] = odds
    return Lexicon({w: f[2] for w, f in sorted(words.items())}, stems)


def learn(sample: DataFrame) -> Lexicon:
    """Sequential covering: what explains toxic rows is learned first, then what explains the rows that are left."""
    found: dict[str, tuple[int, float, float]] = {}
    rest = sample
    for _ in range(ROUNDS):
        before = len(found)
        learn_terms(rest, found)
        lexicon = chosen(found)
        if len(found) == before:
            break

        def unexplained(batches: Iterator[pd.DataFrame], lexicon: Lexicon = lexicon) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = [not toxic or lexicon.exact(set(WORD.findall(text.lower()))) < 4 for text, toxic in zip(batch["text"], batch["toxic"], strict=True)]
                yield batch[np.array(keep, bool)]

        rest = sample.mapInPandas(unexplained, sample.schema)
    return chosen(found)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = store.stage(labelled(docs, labels), "toxicity-sample").cache()
    lexicon = learn(sample)
    automaton = Automaton(lexicon, stem_edits=True)

    def misspelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, found = features(list(batch["text"]), automaton, lexicon)
            yield pd.DataFrame({"word": sorted(set().union(*found))}, dtype=str)

    clean = sample.where("toxic = 0").mapInPandas(misspelled, "word string").distinct()
    lexicon.innocent = frozenset(r["word"] for r in clean.collect())

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, _ = features(list(batch["text"]), automaton, lexicon)
            yield pd.DataFrame(rows, columns=list(FEATURES)).assign(toxic=batch["toxic"].to_numpy())

    known = sample.mapInPandas(measured, ", ".join(f"{f} double" for f in FEATURES) + ", toxic int").toPandas()  # FIT_ROWS rows at most
    sample.unpersist()
    weights = logistic(known[list(FEATURES)].to_numpy(), known["toxic"].to_numpy()) if len(known) else PRIOR
    return Model(lexicon, automaton, weights)


def score(docs: DataFrame, model: Model, text: str = "text", least_rejected: float | None = None) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) for each row; with ``least_rejected``, only the rows below it, unchanged."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    fields = list(docs.schema.fields)
    schema = T.StructType(fields if least_rejected is not None else [*(f for f in fields if f.name not in (text, "toxicity")), T.StructField("toxicity", T.DoubleType())])

    def work(batch: pa.RecordBatch) -> dict[str, Any]:
        m = broadcast.value
        rows, _ = features([x or "" for x in batch.column(text).to_pylist()], m.automaton, m.lexicon)
        found = m.scores(rows)
        if least_rejected is None:
            return {f.name: batch.column(f.name) for f in fields} | {"toxicity": found}
        keep = pa.array(found < least_rejected)
        return {f.name: batch.column(f.name).filter(keep) for f in fields}

    return map_texts(docs, text, schema, work)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with all their columns."""
    return score(docs, fit(docs, labels), least_rejected=THRESHOLD)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, store.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
