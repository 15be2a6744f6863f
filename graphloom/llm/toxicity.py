"""Operator 11: toxicity.

Method: a lexicon learnt from labels is a trie of words and of stems with free endings; the
Levenshtein automata of its terms run over it together, so one walk over a word's letters
finds the terms within their allowed edits.  The product is made deterministic state by
state, as words ask for it, and walked for all distinct words of a slice at once in numpy.
Every match is weighed by a window of words around it (quotation marks, words of reporting,
words of address, other matches), which tells quotation from abuse, and a logistic model
over a document's sums and its worst window gives the score.

Labels teach from at most ``SAMPLE`` documents, the one bound on what is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnp
from .common import materialize, text_slices
from .quality import held_out

#: documented bound of the labelled sample (half of it for either label), and the rest of the model's parameters
SAMPLE = 20_000
#: terms need so many toxic documents, and such a lower bound (by Z deviations) of their log-odds; stems have so many letters
MIN_DOCS, LEAST, Z, SHORTEST, LONGEST, TERMS = 5, 2.0, 2.0, 3, 12, 5_000
#: of a term's documents, the share that a longer form must keep to stand for it
SAME = 0.9
THRESHOLD = 0.5
WINDOW = 6
STATES = 1 << 17

# fixed values: words that report speech or name words, and words that address somebody
REPORTING = frozenset("said says wrote written called calls word words term phrase quote quoted quotes reported headline slur insult sagte schrieb nannte wort begriff zitat dit écrit appelé mot terme citation dijo escribió llamó palabra término cita".split())
ADDRESS = frozenset("you your yours youre u ur du dich dir dein deine ihr euch tu toi ton vous votre tú usted ustedes vosotros eres".split())
QUOTES = np.array([0x22, 0xAB, 0xBB, 0x201C, 0x201D, 0x201E], np.uint32)

_MASKED = np.isin(np.arange(128), [ord(c) for c in "*@$"])


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case form, is part of a word) of the code points below 65,536."""
    low = np.arange(1 << 16, dtype=np.uint32)
    for a, b, by in ((0x41, 0x5A, 32), (0xC0, 0xD6, 32), (0xD8, 0xDE, 32), (0x391, 0x3A9, 32), (0x410, 0x42F, 32), (0x400, 0x40F, 80)):
        low[a : b + 1] += by
    word = np.ones(1 << 16, bool)
    word[:0x80] = [chr(c).isalnum() for c in range(0x80)]
    for a, b in ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFF0F)):
        word[a : b + 1] = False
    return low, word


_LOW, _WORD = _classes()


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice and the rows' offsets among them."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = data.tobytes().decode("utf-8", "surrogatepass")
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), heads[offsets]


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased code points, starts, ends, first word of each row + total).

    Words are runs of letters and digits; a ``*``, ``@`` or ``$`` between two of those is part
    of the word, as in masked terms.
    """
    n = len(points)
    bmp = np.minimum(points, 0xFFFF)
    inside = _WORD[bmp]
    low = np.where(points < 1 << 16, _LOW[bmp], points)
    if n == 0:
        z = np.zeros(0, np.int64)
        return low, z, z, np.zeros(len(offsets), np.int64)
    mask = np.flatnonzero((points < 128) & _MASKED[np.minimum(points, 127)])
    mask = mask[(mask > 0) & (mask < n - 1)]
    inside[mask] = inside[mask - 1] & inside[np.minimum(mask + 1, n - 1)]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def hash_text(text: str) -> int:
    points = np.array([ord(c) for c in text], np.uint64)
    s, q = textnp.prefix_hash(points)
    return int(textnp.span_hash(s, q, np.array([0]), np.array([len(points)]))[0])


@dataclass
class Term:
    """A word, or a stem that any ending may follow."""

    text: str
    stem: bool
    weight: float

    @property
    def edits(self) -> int:
        n = len(self.text)
        return int(n >= 8) if self.stem else 0 if n < 4 else 1 if n < 8 else 2

    def gain(self, distance: int) -> float:
        return self.weight * ((1.0, 0.4) if self.stem else (1.0, 0.7, 0.45))[distance]


class Matcher:
    """The terms' Levenshtein automata, run together over their trie.

    A state is a set of (trie node, edits so far); those met are numbered and their moves
    kept in a table by letter.  Letters that no term has are one.  Beyond ``STATES`` states
    the table is begun anew.
    """

    def __init__(self, terms: list[Term]) -> None:
        self.terms = terms
        self.kids: list[dict[int, int]] = [{}]
        self.most, self.words, self.stems = [0], [[]], [[]]
        alphabet = sorted({c for t in terms for c in t.text})
        self.alphabet = np.array([*map(ord, alphabet), 1 << 31], np.uint32)
        code = {c: i + 1 for i, c in enumerate(alphabet)}
        self.width = len(alphabet) + 1
        for i, t in enumerate(terms):
            at, path = 0, [0]
            for c in t.text:
                at = self.kids[at].setdefault(code[c], len(self.kids))
                if at == len(self.kids):
                    self.kids.append({})
                    self.most.append(0)
                    self.words.append([])
                    self.stems.append([])
                path.append(at)
            (self.stems if t.stem else self.words)[at].append(i)
            for node in path:
                self.most[node] = max(self.most[node], t.edits)
        self.begin()

    def begin(self) -> None:
        self.number: dict[tuple, int] = {(): 0}
        self.sets: list[tuple] = [()]
        self.table = np.full((1024, self.width), -1, np.int32)
        self.table[0] = 0
        # per state and way of matching (whole word, stem): gain, term, distance
        self.gain = np.zeros((1024, 2))
        self.term = np.full((1024, 2), -1, np.int32)
        self.far = np.zeros((1024, 2), np.int8)
        self.start = self.state({0: 0})

    def state(self, at: dict[int, int]) -> int:
        """Number of the state of these nodes and all that leaving letters out reaches."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if at[node] < e:
                continue
            for kid in self.kids[node].values():
                if e + 1 <= self.most[kid] and e + 1 < at.get(kid, 99):
                    at[kid] = e + 1
                    todo.append((kid, e + 1))
        key = tuple(sorted(at.items()))
        n = self.number.get(key)
        if n is not None:
            return n
        n = self.number[key] = len(self.sets)
        self.sets.append(key)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.gain, self.term, self.far = (np.concatenate([x, np.zeros_like(x)]) for x in (self.gain, self.term, self.far))
        self.table[n] = -1
        self.gain[n], self.term[n] = 0, -1
        for node, e in key:
            for way, kinds in enumerate((self.words, self.stems)):
                for i in kinds[node]:
                    t = self.terms[i]
                    if e <= t.edits and t.gain(e) > self.gain[n, way]:
                        self.gain[n, way], self.term[n, way], self.far[n, way] = t.gain(e), i, e
        return n

    def move(self, n: int, letter: int) -> int:
        at: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and e < at.get(node, 99):
                at[node] = e

        for node, e in self.sets[n]:
            put(node, e + 1)
            for c, kid in self.kids[node].items():
                put(kid, e + (c != letter))
        return self.state(at)

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term or -1, distance) of each word: that of the greatest gain."""
        if len(self.sets) > STATES:
            self.begin()
        n, size = len(starts), ends - starts
        best, term, far = np.zeros(n), np.full(n, -1, np.int32), np.zeros(n, np.int8)
        state, on, j = np.full(n, self.start, np.int32), np.arange(n), 0
        while len(on := on[size[on] > j]):
            c = points[starts[on] + j].astype(np.uint32)
            i = np.searchsorted(self.alphabet, c)
            c = np.where(self.alphabet[i] == c, i + 1, 0)
            s = self.table[state[on], c]
            if (s < 0).any():
                for a, b in {*zip(state[on][s < 0].tolist(), c[s < 0].tolist(), strict=True)}:
                    to = self.move(a, b)
                    self.table[a, b] = to
                s = self.table[state[on], c]
            state[on] = s
            for way, who in ((1, slice(None)), (0, size[on] == j + 1)):
                at, x = on[who], s[who]
                up = self.gain[x, way] > best[at]
                at, x = at[up], x[up]
                best[at], term[at], far[at] = self.gain[x, way], self.term[x, way], self.far[x, way]
            on = on[s > 0]
            j += 1
        return term, far


@dataclass
class Model:
    """Terms, the hashes of words that are no misspellings, and the weights of a document's features."""

    terms: list[Term] = field(default_factory=list)
    plain: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


_cues: dict[str, np.ndarray] = {}


def _cue(name: str, of: frozenset) -> np.ndarray:
    if name not in _cues:
        _cues[name] = np.array(sorted(hash_text(w) for w in of), np.uint64)
    return _cues[name]


def _distinct(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, a place of each, number of each word among them)."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = textnp.span_hash(*textnp.prefix_hash(low), starts, ends)
    return np.unique(h, return_index=True, return_inverse=True)


@dataclass
class Hits:
    """Matches of a slice: row, word and characters, term, distance and score in its context, and the rows' features."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    term: np.ndarray
    far: np.ndarray
    score: np.ndarray
    hash: np.ndarray
    x: np.ndarray


#: features: one, exact matches, misspelt ones, what context takes off, the worst window; none falls with a text's length
PRIOR = np.array([-4.0, 2.5, 2.0, 0.0, 1.5])


def find(model: Model, matcher: Matcher, data: np.ndarray, offsets: np.ndarray) -> Hits:
    points, rows = letters(data, offsets)
    low, starts, ends, first = words(points, rows)
    n = len(rows) - 1
    hashes, place, which = _distinct(low, starts, ends)
    term, far = matcher.match(low, starts[place], ends[place])
    term[(far > 0) & np.isin(hashes, model.plain)] = -1
    at = np.flatnonzero(term[which] >= 0) if len(which) else np.zeros(0, np.int64)
    term, far, h = term[which[at]], far[which[at]].astype(np.int64), hashes[which[at]]
    row = np.searchsorted(first, at, "right") - 1
    lo, hi = np.maximum(at - WINDOW, first[row]), np.minimum(at + WINDOW + 1, first[row + 1])

    def near(name: str, cues: frozenset) -> np.ndarray:
        if not len(at):
            return np.zeros(0, bool)
        total = np.concatenate([[0], np.cumsum(np.isin(hashes, _cue(name, cues))[which])])
        return total[hi] > total[lo]

    a, b = np.searchsorted(at, lo), np.searchsorted(at, hi)
    lines = np.union1d(np.flatnonzero(points == 0x0A) + 1, rows)
    line = lines[np.searchsorted(lines, starts[at], "right") - 1] if len(at) else at
    marks = np.flatnonzero(np.isin(points, QUOTES))
    quoted = (np.searchsorted(marks, starts[at]) - np.searchsorted(marks, line)) % 2 == 1
    # a closing mark must follow on the line, so that a lone one quotes nothing
    until = np.append(lines, len(points))[np.searchsorted(lines, starts[at], "right")] if len(at) else at
    quoted &= np.searchsorted(marks, until) > np.searchsorted(marks, starts[at])
    z = 1.5 + 0.75 * near("address", ADDRESS) + 0.5 * np.minimum(b - a - 1, 3) - 3.0 * quoted - 1.0 * near("reporting", REPORTING)
    factor = 1 / (1 + np.exp(-z))
    gain = np.array([model.terms[t].gain(d) for t, d in zip(term.tolist(), far.tolist(), strict=True)], float)
    score = gain * factor

    def per(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=x, minlength=n)

    total = np.concatenate([[0], np.cumsum(score)])
    worst = np.zeros(n)
    np.maximum.at(worst, row, total[b] - total[a])
    x = np.stack([np.ones(n), np.log1p(per(score * (far == 0))), np.log1p(per(score * (far > 0))), np.log1p(per(gain - score)), np.log1p(worst)], axis=1)
    return Hits(row, starts[at] - rows[row], ends[at] - rows[row], term, far, score, h, x)


def sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(t, y): up to half of ``most`` documents of either label, those of the smallest id hashes, written once."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    known = known.withColumn("y", F.col("y") >= 0.5)
    picked = None
    for y in (True, False):
        half = known.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(most // 2)
        picked = half if picked is None else picked.unionByName(half)
    # at most ``most`` ids are broadcast; repeated ids may bring more rows than labels, so the rows are bounded as well
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(picked), F.col("id") == F.col("__id")).select("id", "t", "y")
    joined = materialize(joined, "toxicity-sample")
    rows = joined.groupBy("y").count().collect()
    if all(r["count"] <= most // 2 for r in rows):
        return joined.select("t", "y")
    halves = [joined.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id", "t").limit(most // 2) for y in (True, False)]
    return materialize(halves[0].unionByName(halves[1]).select("t", "y"), "toxicity-sample")


def _forms(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
    """Each row's distinct words and stems: (hash, row, start, end, is a stem)."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s, q = textnp.prefix_hash(low)
    parts = []
    for k in (0, *range(SHORTEST, LONGEST + 1)):
        fit = (ends - starts >= max(k, SHORTEST)) if k else (ends - starts >= 2)
        a, r = starts[fit], row[fit]
        b = a + k if k else ends[fit]
        # words and stems of the same letters are told apart by one bit
        h = (textnp.span_hash(s, q, a, b) << np.uint64(1)) | np.uint64(k > 0)
        _, keep = np.unique(np.stack([h, r.astype(np.uint64)]), axis=1, return_index=True) if len(h) else (None, np.zeros(0, np.int64))
        parts.append((h[keep], r[keep], a[keep], b[keep]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _count_forms(among):
    """Per slice: how many documents have each form, of the given forms only where there are any given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_slices(batch, "t"):
                points, rows = letters(data, offsets)
                low, starts, ends, first = words(points, rows)
                h, _, a, b = _forms(low, starts, ends, first)
                if among is not None:
                    h = h[np.isin(h, among.value)]
                values, at, n = np.unique(h, return_index=True, return_counts=True)
                texts = pa.nulls(len(values), pa.string()) if among is not None else pa.array(["".join(map(chr, low[i:j].tolist())) for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), texts, pa.array(n.astype(np.int64))], ["form", "text", "n"])

    return run


def lexicon(rows: DataFrame) -> list[Term]:
    """Words and stems that toxic documents have and others lack.

    Forms are counted by documents; those of enough toxic ones are looked up in the rest.
    A stem stands only where no longer form keeps nearly all of its documents, and a form
    with a stem of about its own odds goes.  Weights grow with the odds, up to 1.
    """
    context = rows.sparkSession.sparkContext
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = size.get(True, 0), size.get(False, 0)
    if not toxic or not clean:
        return []
    counted = "form long, text string, n long"
    t = rows.where("y").select("t").mapInArrow(_count_forms(None), counted).groupBy("form").agg(F.min("text").alias("text"), F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS).collect()
    among = np.array([r["form"] for r in t], np.int64).view(np.uint64)
    # forms of at least MIN_DOCS of the sample's documents
    c = rows.where("not y").select("t").mapInArrow(_count_forms(context.broadcast(among)), counted).groupBy("form").agg(F.sum("n").alias("n")).collect()
    clean_of = {r["form"]: r["n"] for r in c}
    found: dict[tuple[str, bool], tuple[int, float]] = {}
    for r in t:
        n, m = r["n"], clean_of.get(r["form"], 0)
        odds = np.log((n + 0.5) / (toxic + 1)) - np.log((m + 0.5) / (clean + 1))
        least = odds - Z * np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
        if least >= LEAST:
            found[r["text"], bool(r["form"] & 1)] = n, float(least)
    longer: dict[str, int] = {}
    for (text, stem), (n, _) in found.items():
        of = text[:-1] if stem else text
        longer[of] = max(longer.get(of, 0), n)
    kept = {k: v for k, v in found.items() if not k[1] or longer.get(k[0], 0) < SAME * v[0]}
    terms = []
    for (text, stem), (n, least) in kept.items():
        above = (kept.get((text[:i], True)) for i in range(SHORTEST, len(text) + (not stem)))
        if not any(a is not None and a[1] >= least - 1 for a in above):
            terms.append((least, n, Term(text, stem, float(np.tanh(least / 3)))))
    terms.sort(key=lambda x: (-x[0], -x[1], x[2].text, x[2].stem))
    return [t for _, _, t in terms[:TERMS]]


def _misspelt(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.value.terms)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "t"):
                hits = find(model.value, matcher, data, offsets)
                pairs = np.unique(np.stack([hits.hash, hits.row.astype(np.uint64)])[:, hits.far > 0], axis=1)
                y = rows.column("y").to_numpy(zero_copy_only=False)[pairs[1].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(y.astype(np.int64)), pa.array((~y.astype(bool)).astype(np.int64))], ["form", "toxic", "clean"])

    return run


def _features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.value.terms)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([rows.column("y"), pa.array(list(find(model.value, matcher, data, offsets).x), pa.list_(pa.float64()))], ["y", "x"])

    return run


def fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to ``PRIOR``: what the rows say nothing of stays there."""
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (p - y) + pull * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), g)
        # short steps keep it from running off on separable rows
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Lexicon, words that are no misspellings, and weights, from the labelled documents outside the held-out fold.

    At most half of ``sample_rows`` documents of either label teach, which are written once
    and read three times.  Null ids and labels teach nothing; repeated labels are averaged.
    Null and empty texts teach that nothing is there.  Texts count whole.  Ties go by hash
    and id, so reruns agree.  Without rows of both labels the lexicon is empty, and every
    document scores alike.
    """
    rows = sample(docs, labels, sample_rows, id_col, text_col, label_col)
    context = rows.sparkSession.sparkContext
    model = Model(lexicon(rows), weights=PRIOR)
    if model.terms:
        # a near form that clean documents have too is a word of its own
        near = rows.mapInArrow(_misspelt(context.broadcast(model)), "form long, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("clean > 0 and toxic < 8 * clean").collect()
        model.plain = np.array(sorted(r["form"] for r in near), np.int64).view(np.uint64)
    got = rows.mapInArrow(_features(context.broadcast(model)), "y boolean, x array<double>").collect()
    if got:
        order = sorted((r["x"], r["y"]) for r in got)
        model.weights = fit(np.array([x for x, _ in order]), np.array([float(y) for _, y in order]))
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus score, predicted and hits (characters, term, distance, score in context); clashing columns are replaced.

    Null and empty texts have no matches; a text of any length is read whole, with some 100
    bytes of memory a byte.  Rows with null or repeated ids and repeated rows are kept; equal
    texts score alike.  An empty table stays empty.
    """
    docs = docs.drop("score", "predicted", "hits")
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("distance", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = Matcher(model.terms)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, text_col):
                hits = find(model, matcher, data, offsets)
                s = model.score(hits.x)
                spans = pa.StructArray.from_arrays([pa.array(hits.start.astype(np.int32)), pa.array(hits.end.astype(np.int32)), pa.array([model.terms[t].text for t in hits.term.tolist()], pa.string()), pa.array(hits.far.astype(np.int32)), pa.array(hits.score)], fields=list(span))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(hits.row, np.arange(rows.num_rows + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(s), pa.array((s >= threshold).astype(np.int32)), lists], [*columns, "score", "predicted", "hits"])

    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("distance", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("hits", kind)]))
