"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Words are compared by the gap-weighted subsequence kernel: two words are alike as far as they share
subsequences of three letters, each weighted down by the letters it skips, so inserted or dropped
characters cost a little and not everything.  Words are normalised first: case, accents, digits that
stand for letters, and anything put between letters go, letters of other scripts are dealt over the 26, and
letters standing alone in a row are one word.

Sentences are compared by the convolution kernel over their words, the sum over pairs of words of the
``POWER``-th power of the word kernel (powers and sums of kernels are kernels); the power lets nearly equal
words count and chance likeness vanish.  Landmarks are words of labelled documents, as sentences of one
word.  The kernels of a sentence with them and their own kernel matrix give its Nyström features,
on which a linear SVM is trained.  Labels are of documents, so a toxic document is
represented by the sentence that the current machine finds most toxic (multiple-instance training).
The words that stand for toxicity also train the machine with a letter inserted, doubled or dropped.  A
document is judged by its ``WORST`` worst sentences, whose margins a sigmoid turns into a probability.

The fit uses at most ``MAX_LABELLED`` labelled documents of each class, chosen by a hash of the id, and
runs in one task; the driver gets the landmarks and their weights.
Scale: scoring is one pass without a shuffle.  Kernels are computed once per distinct word and task
(the table of words has a bounded size), and only words near a landmark cost anything per sentence.
"""

from __future__ import annotations

import math
import pickle
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.llm.base import fresh
from chronolane.llm.textscan import NON_SPACE, chunks, scan

MAX_LABELLED = 2500
LANDMARKS = 64
DECAY = 0.7
SPAN = 5  # letters that a subsequence of three may lie across
NEAR = 0.3  # smaller word kernels count as 0 (their power is below 0.03)
POWER = 3
WORST = 3
CANDIDATES = 3000
CHUNK_BYTES = 4 << 20
CACHE = 250_000
_LETTERS = 27
_CODES = _LETTERS**3
_FROM, _TO = "0134579@", "oieastga"
_DELETE = bytes(b for b in range(128) if not chr(b).isalpha() and chr(b) not in _FROM)
_TABLE = bytes(bytearray(range(256))).lower()
_TABLE = _TABLE.translate(bytes.maketrans(_FROM.encode(), _TO.encode()))
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True


#: Letters that don't decompose into a letter and an accent (fixed values).
_PLAIN = {"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"}


class _Letters(dict):
    """What a character is among the 26 letters: letters of other scripts are dealt over them, one for an
    alphabet's (before U+0900), two for others; what is no letter goes."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code < 0x80:
            found = c
        elif c in _PLAIN:
            found = _PLAIN[c]
        elif not c.isalpha():
            found = ""
        else:
            found = chr(0x61 + code % 26) if code < 0x900 else chr(0x61 + code // 26 % 26) + chr(0x61 + code % 26)
        self[code] = found
        return found


_LETTERS_OF = _Letters()


def normalise(word: bytes) -> bytes:
    """A word in the letters a-z: case and accents are folded, digits become the letters they imitate, other scripts' letters are dealt over the 26, the rest goes."""
    if not word.isascii():
        text = unicodedata.normalize("NFKD", word.decode("utf-8", "replace").casefold())
        if len(_LETTERS_OF) > 200_000:
            _LETTERS_OF.clear()
        word = text.translate(_LETTERS_OF).encode("ascii")
    return word.translate(_TABLE, _DELETE)


def _triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of every subsequence of three letters within SPAN, a mark standing before the first letter."""
    flat = np.frombuffer(b"".join(b"\x60" + w for w in words), np.uint8).astype(np.int32) - 0x60
    size = np.array([len(w) + 1 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)[owner]
    at, owners, codes, weights = np.arange(len(flat)), [], [], []
    for d2 in range(2, SPAN):
        use = at[at + d2 < ends]
        for d1 in range(1, d2):
            owners.append(owner[use])
            codes.append((flat[use] * _LETTERS + flat[use + d1]) * _LETTERS + flat[use + d2])
            weights.append(np.full(len(use), DECAY ** (d2 - 2), np.float32))
    return np.concatenate(owners), np.concatenate(codes), np.concatenate(weights)


def may_be_near(words: list[bytes], bound: np.ndarray) -> np.ndarray:
    """Whether a word's kernel with any landmark can reach NEAR; ``bound`` has the largest feature of a landmark per code."""
    owner, code, weight = _triples(words)
    most = np.bincount(owner, weights=weight * bound[code], minlength=len(words))
    norm = np.sqrt(np.bincount(owner, weights=weight**2, minlength=len(words)))  # repeats would only add to it
    return most >= NEAR * np.maximum(norm, 1e-12)


class Subsequences:
    """The explicit features of words: normalised weights of their three-letter subsequences."""

    def __init__(self, words: list[bytes]):
        owner, code, each = _triples(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        key = owner * _CODES + code
        known, inv = np.unique(key, return_inverse=True)
        weight = np.bincount(inv, weights=each, minlength=len(known))
        self.n, self.word, self.code = len(words), known // _CODES, known % _CODES
        norm = np.sqrt(np.bincount(self.word, weights=weight**2, minlength=self.n))
        self.weight = (weight / np.maximum(norm, 1e-12)[self.word]).astype(np.float32)
        self.first = np.searchsorted(self.word, np.arange(self.n + 1))

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """A table (code, word) of the normalised features of some words."""
        out = np.zeros((_CODES, len(rows)), np.float32)
        for k, r in enumerate(rows):
            s = slice(self.first[r], self.first[r + 1])
            out[self.code[s], k] = self.weight[s]
        return out

    def kernel(self, table: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """Normalised kernels of all words with those of a table; words without a subsequence have none."""
        out = np.zeros((self.n, table.shape[1]), np.float32)
        at = 0
        while at < self.n:
            to = max(at + 1, int(np.searchsorted(self.first, self.first[at] + block, "right")) - 1)
            s = slice(self.first[at], self.first[to])
            rows = np.flatnonzero(np.diff(self.first[at : to + 1]))
            if len(rows):
                out[at + rows] = np.add.reduceat(table[self.code[s]] * self.weight[s, None], self.first[at + rows] - self.first[at])
            at = to
        return out


def _sentences(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, joined words, and per word its sentence; per sentence its row.

    Letters standing alone in a row (three or more) are joined: the joined words are listed with the
    sentence they begin in, after all others.
    """
    words = scan(column, NON_SPACE)
    row = words.row()
    n = len(words.start)
    if not n:
        z = np.zeros(0, np.int64)
        return words.hashes(), [], z, z, z
    data = words.data
    stop = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_STOPS[data], out=stop[1:])
    new = np.ones(n, bool)
    new[1:] = (row[1:] != row[:-1]) | (stop[words.start[1:]] > stop[words.start[:-1] + 0])
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data >= 0x61) & (data <= 0x7A)) | (data >= 0xC0), out=letters[1:])
    single = (letters[words.end] - letters[words.start] == 1) & (words.end - words.start <= 3)
    # a stop between single letters is something put between them, not the end of a sentence
    both = np.zeros(n, bool)
    both[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1])
    new &= ~both
    sentence = np.cumsum(new) - 1
    joined, where = [], []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        cuts = [a, *(k for k in range(a + 1, b) if row[k] != row[k - 1]), b]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s >= 3:
                joined.append(b"".join(data[words.start[k] : words.end[k]].tobytes() for k in range(s, e)))
                where.append(sentence[s])
    return words, joined, sentence, np.array(where, np.int64), row[np.flatnonzero(new)]


@dataclass
class Model:
    landmarks: list[bytes]
    weights: np.ndarray  # per landmark, after whitening
    bias: float
    slopes: np.ndarray  # per rank among a document's worst sentences
    shift: float

    def __post_init__(self):
        found = Subsequences(self.landmarks)
        self.table = found.dense(np.arange(len(self.landmarks)))
        self.bound = self.table.max(axis=1)

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(worst @ self.slopes + self.shift, -50, 50)))

    def worst(self, row: np.ndarray, margin: np.ndarray, rows: int) -> np.ndarray:
        """The margins of each row's WORST worst sentences; sentences without any word near a landmark have the bias."""
        out = np.full((rows, WORST), self.bias)
        order = np.lexsort((-margin, row))
        row, margin = row[order], margin[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        use = (rank < WORST) & (margin > self.bias)
        out[row[use], rank[use]] = margin[use]
        return out


def _powered(kernel: np.ndarray) -> np.ndarray:
    return (np.where(kernel >= NEAR, kernel, 0) ** POWER).astype(np.float32)


class WordTable:
    """Powers of the kernels with the landmarks per distinct word; words near none share row 0."""

    def __init__(self, model: Model, room: int = CACHE):
        self.model, self.room = model, room
        self.clear()

    def clear(self) -> None:
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.rows = np.zeros((1, len(self.model.landmarks)), np.float32)

    def kernels(self, raw: list[bytes]) -> np.ndarray:
        """Powers of the kernels of raw words with the landmarks."""
        out = np.zeros((len(raw), len(self.model.landmarks)), np.float32)
        if raw:
            words = [normalise(w) for w in raw]
            near = np.flatnonzero(may_be_near(words, self.model.bound))
            if len(near):
                out[near] = _powered(Subsequences([words[k] for k in near.tolist()]).kernel(self.model.table))
        return out

    def lookup(self, words) -> np.ndarray:
        """The row of each word, computing those that are new."""
        hashes = words.hashes()
        known, at, inv = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hash) + len(known) > self.room:
            self.clear()
        spot = np.searchsorted(self.hash, known)
        have = np.zeros(len(known), bool)
        inside = spot < len(self.hash)
        have[inside] = self.hash[spot[inside]] == known[inside]
        fresh_ = np.flatnonzero(~have)
        if len(fresh_):
            raw = [words.data[words.start[k] : words.end[k]].tobytes() for k in at[fresh_].tolist()]
            got = self.kernels(raw)
            near = got.any(axis=1)
            place = np.zeros(len(fresh_), np.int64)
            place[near] = np.arange(int(near.sum())) + len(self.rows)
            self.rows = np.concatenate([self.rows, got[near]])
            both = np.concatenate([self.hash, known[fresh_]])
            order = np.argsort(both)
            self.hash, self.place = both[order], np.concatenate([self.place, place])[order]
        return self.place[np.searchsorted(self.hash, known)][inv]

    def pooled(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, kernels with the landmarks) of each sentence that has a word near one."""
        words, joined, sentence, where, row = _sentences(column)
        if not len(row):
            return np.zeros(0, np.int64), np.zeros((0, len(self.model.landmarks)), np.float32)
        place = self.lookup(words)
        use = np.flatnonzero(place)
        values, owner = self.rows[place[use]], sentence[use]
        if joined:
            extra = self.kernels(joined)
            values, owner = np.concatenate([values, extra]), np.concatenate([owner, where])
            order = np.argsort(owner, kind="stable")
            values, owner = values[order], owner[order]
        if not len(owner):
            return np.zeros(0, np.int64), values
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        return row[owner[begin]], np.add.reduceat(values, begin)


def _choose(positive: list[set], negative: list[set], count: int) -> tuple[list[bytes], int]:
    """Landmarks: words that toxic documents have and others don't, each for documents that none before it explains; then the clean words most like them."""
    p, n = Counter(w for s in positive for w in s), Counter(w for s in negative for w in s)
    least = 2 if len(positive) < 500 else 4
    words = [w for w in p if p[w] >= least and len(w) >= 3 and p[w] / len(positive) > 3 * n[w] / max(1, len(negative))]
    if not words:
        words = [w for w, _ in p.most_common(count) if len(w) >= 3] or [b"toxic"]
    rate = lambda have: np.log((have + 0.1) / len(positive)) - np.log((clean + 0.5) / max(1, len(negative)))
    words.sort()
    clean, have = (np.array([c[w] for w in words], float) for c in (n, p))
    top = np.argsort(-have * rate(have), kind="stable")[:CANDIDATES]
    words, clean = [words[k] for k in top], clean[top]
    number = {w: k for k, w in enumerate(words)}
    found = Subsequences(words)
    holders = [[] for _ in words]
    for d, s in enumerate(positive):
        for w in s:
            if w in number:
                holders[number[w]].append(d)
    need = np.ones(len(positive))
    live, chosen = np.ones(len(words), bool), []
    for _ in range(count // 2):
        have = np.array([need[h].sum() for h in holders])
        gain = np.where(live, have * rate(have), -np.inf)
        best = int(np.argmax(gain))
        if not gain[best] > 0:
            break
        chosen.append(best)
        like = found.kernel(found.dense(np.array([best])))[:, 0] >= 0.6
        live &= ~like
        met = np.unique(np.concatenate([holders[k] for k in np.flatnonzero(like)]).astype(np.int64))
        need[met] *= 0.8  # explained documents count less for the next
    toxic = [words[k] for k in chosen] or words[:1]
    common = [w for w, _ in n.most_common(20_000) if w not in number and len(w) >= 3]
    if common:
        near = Subsequences(common).kernel(Subsequences(toxic).dense(np.arange(len(toxic)))).max(axis=1)
        common = [common[k] for k in np.argsort(-near, kind="stable")[: count - len(toxic)]]
    return toxic + [w for w in common if w not in toxic], len(toxic)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps on the primal (the last feature is the bias)."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _sigmoid(worst: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of P(y = 1) over the worst margins, by weighted logistic regression."""
    theta = np.zeros(worst.shape[1] + 1)
    x = np.concatenate([worst, np.ones((len(worst), 1))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 1e-2 * theta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(theta)) * 1e-2
        step = np.linalg.solve(hess, grad)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return theta[:-1], float(theta[-1])


def variants(word: bytes) -> list[bytes]:
    """A word with a letter inserted, doubled or dropped, at every inner place."""
    out = [word[:k] + bytes([0x61 + (7 * k + len(word)) % 26]) + word[k:] for k in range(1, len(word))]
    out += [word[:k] + word[k - 1 : k] + word[k:] for k in range(1, len(word))]
    return out + [word[:k] + word[k + 1 :] for k in range(1, len(word) - 1) if len(word) > 4]


def train(texts: list[str], toxic: list[int], prior: float | None = None, landmarks: int = LANDMARKS, rounds: int = 4) -> Model:
    """Fit on labelled texts.  prior: the share of toxic documents where the scores will be used (default: as given)."""
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model([b"toxic"], np.zeros(1), 0.0, np.zeros(WORST), math.log((share + 1e-3) / (1 - share + 1e-3)))
    sets = []
    for t in texts:
        words = scan(pa.array([t], pa.large_string()), NON_SPACE)
        raw = {words.data[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)}
        sets.append({w for w in map(normalise, raw) if 3 <= len(w) <= 40})
    names, n_toxic = _choose([s for s, k in zip(sets, y, strict=True) if k], [s for s, k in zip(sets, y, strict=True) if not k], landmarks)
    del sets
    model = Model(names, np.zeros(len(names)), 0.0, np.zeros(WORST), 0.0)
    table = WordTable(model)
    own = Subsequences(names).kernel(model.table).astype(float) ** POWER
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-3
    whiten = vectors[:, good] / np.sqrt(values[good])
    rows, feats = [], []
    column = pa.array(texts, pa.large_string())
    for a, b in chunks(column, CHUNK_BYTES):
        r, f = table.pooled(column.slice(a, b - a))
        rows.append(r + a)
        feats.append(f)
    row, x = np.concatenate(rows), np.concatenate(feats).astype(float) @ whiten
    # every document also has the sentence without any such word
    row, x = np.concatenate([row, np.arange(len(y))]), np.concatenate([x, np.zeros((len(y), x.shape[1]))])
    order = np.argsort(row, kind="stable")
    row, x = row[order], x[order]
    begin = np.searchsorted(row, np.arange(len(y)))
    score = x @ np.linalg.pinv(whiten)[:, :n_toxic].max(axis=1)
    altered = [v for w in names[:n_toxic] for v in variants(w)]
    bent = table.kernels(altered).astype(float)
    bent = bent[bent.max(axis=1) >= 0.5**POWER] @ whiten  # what is left of the word is less than half of it otherwise
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    ends = np.append(begin[1:], len(row))
    for _ in range(rounds):
        worst = np.array([b + int(np.argmax(score[b:e])) for b, e in zip(begin, ends, strict=True)])
        clean = np.flatnonzero(y[row] == 0)
        sample = np.concatenate([x[worst[y == 1]], bent, x[clean]])
        label = np.concatenate([np.ones(n1 + len(bent)), -np.ones(len(clean))])
        unit = 5.0 * len(y)
        cost = np.concatenate([np.full(n1, unit / n1), np.full(len(bent), 0.5 * unit / max(1, len(bent))), np.full(len(clean), 40.0 * unit / (n0 * max(1.0, len(clean) / n0)))])
        w, bias = _svm(sample, label, cost)
        score = x @ w + bias
    fitted = Model(names, whiten @ w, bias, np.zeros(WORST), 0.0)
    share = y.mean()
    prior = share if prior is None else prior
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    fitted.slopes, fitted.shift = _sigmoid(fitted.worst(row, score, len(y)), y.astype(float), weight)
    return fitted


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", most: int = MAX_LABELLED) -> Model:
    """train() on at most ``most`` documents of each class, by a hash of the id; scores are meant for the labels' own mix of classes.

    Labels other than 0 and 1 are ignored; labels without a document count for the mix only.  An id that is
    labelled more than once counts once, as toxic if any label says so; of rows that repeat an id the
    smallest text is used, so reruns give one model.  Null texts are empty, very long ones are used whole.
    Without documents, labels or one of the classes the model gives every text the share of toxic labels.
    """
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    counts = {r[0]: r[1] for r in marks.groupBy("_y").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = None
    for y in (0, 1):
        some = marks.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col(id).alias("_doc"), F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_doc", "_text"])
        m = train(pdf["_text"].tolist(), pdf["_y"].tolist(), prior)
        return pd.DataFrame({"model": [pickle.dumps((m.landmarks, m.weights, m.bias, m.slopes, m.shift))]})

    one = rows.groupBy("_doc", "_y").agg(F.min("_text").alias("_text"))
    found = one.select("_doc", "_text", "_y", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, "model binary").first()
    return Model(*pickle.loads(bytes(found[0]))) if found else train([], [])


def score_texts(model: Model, table: WordTable, column: pa.Array) -> np.ndarray:
    """Probabilities of texts."""
    row, pooled = table.pooled(column)
    return model.probability(model.worst(row, pooled @ model.weights + model.bias, len(column)))


def toxicity(docs: DataFrame, model: Model, text: str = "text", with_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with score, the probability that it is toxic.

    Null, empty and blank texts have no sentences and get the score of a sentence without any word near
    a landmark.  Rows, repeated ones too, are scored one by one from their whole texts, a very long one by
    itself; other columns play no part.  Input columns called like the result column are replaced.  An
    empty input gives an empty result.
    """
    docs = docs.drop("score")
    rest = [c for c in docs.columns if with_text or c != text]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("score", T.DoubleType())])
    scanned = fresh(docs, "scanned")[0]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = held.value
        table = WordTable(own)
        for batch in batches:
            scores = [score_texts(own, table, batch.column(0).slice(a, b - a)) for a, b in chunks(batch.column(0), CHUNK_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate([np.zeros(0), *scores]))], schema.names)

    return docs.select(F.col(text).alias(scanned), *rest).mapInArrow(run, schema)
