"""Operator 12: toxicity by a lexicon trie met with Levenshtein automata, and scores of the windows around what matches."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .common import small_batches

#: Labelled rows of each label that the fit reads at most, the first by a hash of their id.
SAMPLE = 20_000
#: The fitted lexicon: terms at most, toxic rows that hold a term at least, and its log-likelihood ratio at least.
TERMS, LEAST_ROWS, LEAST_RATIO = 1000, 3, 20.0
#: Length of terms; from these lengths on one and two edits are allowed (a swap of neighbours is one).
SHORTEST, LONGEST, ONE_EDIT, TWO_EDITS = 3, 24, 5, 10
#: Words before and after a match that tell its context.
WINDOW = 6
#: Score from which a document is predicted toxic.
THRESHOLD = 0.7
#: Code points of a slice of a long text, cut at a blank; of short texts that are looked at together; states of an automaton that a task keeps.
SLICE, GROUP, STATES = 1 << 21, 1 << 18, 100_000

# Cues that a term is spoken of, and words that address someone.
QUOTES = "\"“”„«»"
REPORTING = ("word", "words", "term", "terms", "called", "said", "says", "wrote", "quote", "quoted", "slur", "insult", "wort", "begriff", "sagte", "nannte", "mot", "terme", "dit", "palabra", "dijo", "llamado")
ADDRESS = ("you", "your", "youre", "u", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "usted", "eres")

#: Features of a document, and the means of the weights before any label is seen: direct matches speak for, quoted ones don't.
FEATURES = ("direct", "strongest", "density", "different", "addressed", "quoted")
BEFORE = np.array([1.0, 0.5, 0.5, 0.5, 0.3, -0.3, -5.0])


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case where that is one code point, and its kind: 1 letter or digit, 2 a sign that stands for a letter, 3 a quotation mark, 0 others."""
    lower = np.arange(0x110000, dtype=np.uint32)
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalnum():
            kind[c] = 1
            if len(y := x.lower()) == 1:
                lower[c] = ord(y)
    for signs, k in (("@$*", 2), (QUOTES, 3)):
        for x in signs:
            kind[ord(x)] = k
    return lower, kind


def budget(term: str) -> int:
    """Edits that a term allows."""
    return (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)


class Automaton:
    """The lexicon's trie met with Levenshtein automata of its terms, made deterministic as far as words lead.

    A state is a set of (node, edits): the trie's nodes that the word so far may stand at. Transitions are filled in when a word first
    takes one, so the table grows with what the texts hold and not with the lexicon, and is given up beyond STATES states.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[int, int]] = [{}]
        self.term, self.room = [-1], [0]  # the term that ends at a node; edits that the terms below it allow
        chars = sorted({c for t in terms for c in t})
        self.code = {c: i + 1 for i, c in enumerate(chars)}  # 0: any other character
        for k, t in enumerate(terms):
            at = 0
            self.room[0] = max(self.room[0], budget(t))
            for c in t:
                nxt = self.children[at].get(self.code[c])
                if nxt is None:
                    nxt = self.children[at][self.code[c]] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.room.append(0)
                at = nxt
                self.room[at] = max(self.room[at], budget(t))
            self.term[at] = k
        self.lengths = (min(map(len, terms), default=1) - 1, max(map(len, terms), default=0) + 2)
        self.classes = np.zeros(0x110000, np.uint16)
        for c, k in self.code.items():
            self.classes[ord(c)] = k
        self.reset()

    def reset(self) -> None:
        self.sets: list[dict] = [{}]  # state 0: no term can be met any more
        self.number = {frozenset(): 0}
        self.table = np.zeros((1, len(self.code) + 1), np.int32)
        self.hit, self.edits = np.full(1, -1, np.int32), np.zeros(1, np.int8)
        self.start = self._state({(0, 0): 0})

    def _closed(self, found: dict) -> dict:
        """With skipped characters of terms; (node, awaited character): fewest edits."""
        todo = list(found.items())
        while todo:
            (node, awaited), e = todo.pop()
            if awaited or found.get((node, 0), 9) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.room[child] and found.get((child, 0), 9) > e + 1:
                    found[child, 0] = e + 1
                    todo.append(((child, 0), e + 1))
        return found

    def _state(self, found: dict) -> int:
        found = self._closed(found)
        key = frozenset((n, a, e) for (n, a), e in found.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(found)
            ends = [(e, self.term[n]) for (n, a), e in found.items() if not a and self.term[n] >= 0 and e <= budget(self.terms[self.term[n]])]
            best = min(ends, default=(0, -1))
            if len(self.sets) > len(self.hit):
                grown = max(64, 2 * len(self.hit))
                self.table = np.vstack([self.table, np.full((grown - len(self.table), self.table.shape[1]), -1, np.int32)])
                self.hit, self.edits = np.resize(self.hit, grown), np.resize(self.edits, grown)
            self.hit[self.number[key]], self.edits[self.number[key]] = best[1], best[0]
            self.table[self.number[key]] = -1
        return self.number[key]

    def _step(self, state: int, char: int) -> int:
        new: dict = {}

        def put(node, awaited, e):
            if e <= self.room[node] and new.get((node, awaited), 9) > e:
                new[node, awaited] = e

        for (node, awaited), e in self.sets[state].items():
            if awaited:  # a swap: the second character has come, now the first
                if char == awaited:
                    put(node, 0, e)
                continue
            put(node, 0, e + 1)
            for c, child in self.children[node].items():
                put(child, 0, e if c == char else e + 1)
                if c != char and char in self.children[child]:
                    put(self.children[child][char], c, e + 1)
        return self._state(new)

    def match(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term or -1, edits) of each word; codes are of lower-case code points. All words take a step at once."""
        if len(self.sets) > STATES:
            self.reset()
        found, edits = np.full(len(starts), -1, np.int32), np.zeros(len(starts), np.int8)
        live = np.flatnonzero((lengths >= self.lengths[0]) & (lengths <= self.lengths[1])) if self.terms else np.zeros(0, np.int64)
        state = np.full(len(live), self.start, np.int32)
        at = 0
        while len(live):
            char = self.classes[codes[starts[live] + at]]
            new = self.table[state, char]
            for s, c in {(int(s), int(c)) for s, c in zip(state[new < 0], char[new < 0], strict=True)}:
                self.table[s, c] = self._step(s, c)
            state = self.table[state, char]
            at += 1
            over = lengths[live] == at
            found[live[over]], edits[live[over]] = self.hit[state[over]], self.edits[state[over]]
            go = ~over & (state > 0)
            live, state = live[go], state[go]
        return found, edits


def _slices(text: str):
    """Whole text in slices that end at a blank, where there is one."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = cut if cut > at else end
        yield at, text[at:end]
        at = end


def _tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case code points, starts, lengths of words, places of quotation marks). A sign between letters belongs to their word."""
    lower, kinds = _tables()
    codes = lower[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    kind = kinds[codes]
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = kind == 1
    inside[2:-2] |= (kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] == 1)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return codes, edge[::2], edge[1::2] - edge[::2], np.flatnonzero(kind == 3)


class Model:
    """Terms with their weights by edits (row: 0, 1, 2), and the weights of a document's features."""

    def __init__(self, terms: list[str], weights: np.ndarray, beta: np.ndarray):
        self.terms, self.weights, self.beta = terms, weights, beta

    def _group(self, texts: list[str]):
        """(matches, number of words) of each text; all are looked at as one, and no window leaves its text."""
        automaton, (reporting, address) = _automaton(tuple(self.terms)), _cues()
        joined = "\n".join(texts)
        codes, starts, lengths, quotes = _tokens(joined)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(starts, begins)
        term, edits = automaton.match(codes, starts, lengths)
        found: list[list] = [[] for _ in texts]
        for i in np.flatnonzero(term >= 0):
            d = int(np.searchsorted(begins, starts[i], "right")) - 1
            a, b = max(first[d], i - WINDOW), min(first[d + 1], i + WINDOW + 1)
            near = {joined[s : s + n].lower() for s, n in zip(starts[a:b].tolist(), lengths[a:b].tolist(), strict=True) if n <= 8}
            marks = np.searchsorted(quotes, (starts[a], starts[i], starts[b - 1] + lengths[b - 1]))
            quoted = bool(marks[0] < marks[1] < marks[2]) or bool(near & reporting)
            at = int(starts[i] - begins[d])
            found[d].append((at, at + int(lengths[i]), int(term[i]), int(edits[i]), quoted, bool(near & address)))
        return list(zip(found, np.diff(first).tolist(), strict=True))

    def matches(self, texts: list[str | None]):
        """For each text ([(start, end, term, edits, quoted, addressed)], number of words): every match in code points, in the whole text.

        Short texts are looked at together, long ones in slices.
        """
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if held and size + len(text) > GROUP:
                yield from self._group(held)
                held, size = [], 0
            if len(text) <= GROUP:
                held.append(text)
                size += len(text) + 1
                continue
            found, words = [], 0
            for begin, part in _slices(text):
                ((own, n),) = self._group([part])
                found += [(begin + s, begin + e, *rest) for s, e, *rest in own]
                words += n
            yield found, words
        if held:
            yield from self._group(held)

    def features(self, texts: list[str | None]):
        """For each text (its features, its matches)."""
        for found, words in self.matches(texts):
            direct = quoted = strongest = addressed = 0.0
            for _, _, t, e, q, a in found:
                w = float(self.weights[e, t])
                if q:
                    quoted += w
                else:
                    direct, strongest, addressed = direct + w, max(strongest, w), addressed + a
            different = len({t for _, _, t, e, q, _ in found if not q and self.weights[e, t] > 0})
            yield np.array([np.log1p(direct), strongest / 4, np.log1p(100 * direct / max(words, 20)), np.log1p(different), np.log1p(addressed), np.log1p(quoted)]), found

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.beta[:-1] + self.beta[-1], -40, 40))))


@lru_cache(4)
def _automaton(terms: tuple[str, ...]) -> Automaton:
    return Automaton(list(terms))


@lru_cache(1)
def _cues() -> tuple[frozenset, frozenset]:
    return frozenset(REPORTING), frozenset(ADDRESS)


def held_out(id_: Column) -> Column:
    """Rows that no fit reads: crc32 of the id as text leaves 1 modulo 3. A null id isn't held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most `sample` labelled rows of each label, none held out."""
    usable = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
    once = usable.groupBy("id").agg(F.max("toxic").alias("toxic"))
    w = W.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")
    ids = once.withColumn("n", F.row_number().over(w)).filter(f"n <= {sample}").drop("n")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(F.broadcast(ids), "id")
    again = W.partitionBy("id").orderBy(F.xxhash64("text"))
    return rows.withColumn("n", F.row_number().over(again)).filter("n = 1").select("text", "toxic")


def lexicon(rows: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(term, n1, n0): words that far more toxic rows hold than clean ones, by the log-likelihood ratio; TERMS at most.

    Words are counted once a row in Arrow batches and summed by Spark; every row of the sample counts.
    """

    def run(batches):
        for b in batches:
            counts: dict[str, list[int]] = {}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = set()
                for _, part in _slices(text):
                    codes, starts, lengths, _ = _tokens(part)
                    fit = (lengths >= SHORTEST) & (lengths <= LONGEST)
                    seen.update(codes[s : s + n].tobytes() for s, n in zip(starts[fit].tolist(), lengths[fit].tolist(), strict=True))
                for w in seen:
                    counts.setdefault(w, [0, 0])[y] += 1
            words = [w.decode("utf-32-le", "surrogatepass").encode("utf-8", "replace").decode() for w in counts]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["term", "n1", "n0"])

    sums = rows.mapInArrow(run, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    share = toxic / max(1, toxic + clean)
    part = lambda n, p: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col("n1") + F.col("n0")) * F.lit(p)))).otherwise(0.0)
    ratio = 2 * (part("n1", share) + part("n0", 1 - share))
    return sums.filter((F.col("n1") >= LEAST_ROWS) & (F.col("n1") * clean > F.col("n0") * toxic)).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(TERMS)


def _odds(n1, n0, toxic: int, clean: int):
    return np.log((n1 + 0.5) / (toxic + 1)) - np.log((n0 + 0.5) / (clean + 1))


def train(x: np.ndarray, y: np.ndarray, steps: int = 40, spread: float = 1.0) -> np.ndarray:
    """Logistic regression around BEFORE, by Newton steps; the bias is free."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    pull = np.append(np.full(x.shape[1], 1 / spread**2), 1e-3)
    beta = BEFORE.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -40, 40)))
        grad = x1.T @ (p - y) + pull * (beta - BEFORE)
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pull + 1e-9), grad)
        beta = beta - step * min(1.0, 4 / (1e-12 + np.abs(step).max()))
    return beta


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels (doc_id, toxic) and their documents, at most `sample` rows a label, none held out.

    Executors count words, match the lexicon and make features; the driver gets the lexicon, counts by term and edits, and
    one short vector for each row of the sample. Without labels of both kinds every score is 0.
    """
    small_batches(docs.sparkSession)
    rows = _sample(docs, labels, sample).persist()
    try:
        clean, toxic = (dict(rows.groupBy("toxic").count().collect()).get(k, 0) for k in (0, 1))
        if not (clean and toxic):
            return Model([], np.zeros((3, 0)), np.append(np.zeros(len(FEATURES)), -40.0))
        found = lexicon(rows, toxic, clean).collect()
        terms = [r.term for r in found]
        exact = np.array([[r.n1, r.n0] for r in found], float).reshape(-1, 2)
        plain = Model(terms, np.ones((3, len(terms))), BEFORE)

        def near(batches):
            """Rows that hold a misspelt term but not the term itself."""
            for b in batches:
                counts: dict[tuple, int] = {}
                for (hits, _), y in zip(plain.matches(b.column(0).to_pylist()), b.column(1).to_pylist(), strict=True):
                    own = {t for _, _, t, e, _, _ in hits if e == 0}
                    for k in {(t, e) for _, _, t, e, _, _ in hits if e and t not in own}:
                        counts[*k, y] = counts.get((*k, y), 0) + 1
                yield pa.RecordBatch.from_pylist([{"t": t, "e": e, "y": y, "n": n} for (t, e, y), n in counts.items()], pa.schema([("t", pa.int32()), ("e", pa.int32()), ("y", pa.int32()), ("n", pa.int64())]))

        weights = np.zeros((3, len(terms)))
        if terms:
            weights[0] = np.maximum(0, _odds(exact[:, 0], exact[:, 1], toxic, clean))
            misspelt = np.zeros((3, len(terms), 2))
            for r in rows.mapInArrow(near, "t int, e int, y int, n long").groupBy("t", "e", "y").agg(F.sum("n").alias("n")).collect():
                misspelt[r.e, r.t, r.y] = r.n
            for e in (1, 2):  # until rows show otherwise, each edit halves what a term is worth
                worth = 0.5**e * weights[0]
                odds = np.log((misspelt[e, :, 1] + 0.5 * np.exp(worth) * toxic / clean) / toxic) - np.log((misspelt[e, :, 0] + 0.5) / clean)
                weights[e] = np.clip(odds, 0, weights[0])
        model = Model(terms, weights, BEFORE)

        def vectors(batches):
            for b in batches:
                x = [x.tolist() for x, _ in model.features(b.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1).cast(pa.int32())], names=["x", "y"])

        got = rows.mapInArrow(vectors, "x array<double>, y int").collect()
        model.beta = train(np.array([r.x for r in got]), np.array([r.y for r in got], float))
        return model
    finally:
        rows.unpersist()


ADDED = {"held_out": T.BooleanType(), "score": T.DoubleType(), "predicted": T.IntegerType(), "matches": T.StringType()}


def annotate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows and columns with held_out, score (0 to 1), predicted (1 from THRESHOLD on) and matches added, each row by its whole text alone.

    matches: a JSON list of [start, end, term, edits, quoted], in code points. Null and empty texts have no match and get the score of
    none. Repeated rows each give a row, null ids stay, an empty table gives none. Columns named like the added ones are replaced.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ADDED]
    kinds = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, t) for c, t in ADDED.items()])
    text_at = len(names) + 1

    def run(batches):
        for b in batches:
            scores, said = [], []
            for x, found in model.features(b.column(text_at).to_pylist()):
                scores.append(model.score(x))
                said.append(json.dumps([[s, e, model.terms[t], d, q] for s, e, t, d, q, _ in found], ensure_ascii=False))
            own = [b.column(i) for i in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(said, pa.string())], names=names + list(ADDED))

    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), held_out(F.col(id_col)).alias("held"), F.col(text_col).cast("string").alias("judged"))
    return rows.mapInArrow(run, kinds)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows: every document's score, learned from labels of rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return annotate(docs, model).drop("text")
