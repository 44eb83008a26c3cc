"""Toxicity by subword bags: embeddings of character n-grams averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams, a window of words the mean of its
words, and a linear layer with softmax tells the window's class; embeddings and layer are trained
together. A misspelt word that was never seen shares most n-grams, and so most of its vector, with
the word it stands for. A document is as toxic as its most toxic window, so a long text cannot
dilute an insult; which windows of a toxic document carry it is worked out while training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.learning import held_out, keep_rows, labelled_sample, sigmoid
from spendlens.llm.shared import named, table

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
DIM = 8
WINDOW, STRIDE = 32, 16
#: Scales the mean of a window, so that one word in ``WINDOW`` can decide.
SCALE = 8.0
#: Labelled documents that are learnt from at most, toxic and clean, and windows taken of each per round.
TOXIC_DOCS, CLEAN_DOCS, TOXIC_WINDOWS, CLEAN_WINDOWS = 2000, 3000, 8, 4
#: Of every thousand sampled documents, so many set the final cut instead of the embeddings.
CALIBRATION = 200
#: An n-gram is learnt if the words that have it occur in so many sampled documents in all.
COMMON = 6
KNOWN_WORDS = 350_000
SCORED = "doc_id long, score double, predicted int, worst_word int"


def core(word: str) -> str:
    """Lower case without the signs around the letters."""
    word = word.lower()
    if word.isalnum():
        return word
    first, last = 0, len(word)
    while first < last and not word[first].isalnum():
        first += 1
    while last > first and not word[last - 1].isalnum():
        last -= 1
    return word[first:last]


def grams(word: str) -> list[int]:
    """Buckets of a word's n-grams; its ends are marked."""
    if not word:
        return []
    marked = f"<{word}>"
    return [crc32(marked[i:i + n].encode()) & (BUCKETS - 1) for n in GRAMS for i in range(max(1, len(marked) - n + 1))
            if n == GRAMS[0] or len(marked) >= n]


#: Remainders of the checksum by byte.
_CRC = np.array([crc32(bytes([x ^ 0xFF])) ^ 0xFF000000 for x in range(256)], dtype=np.uint32)


def all_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of many words and the place of each one's word; a word's come in the order of ``grams``.

    Checksums grow by a character at all places of all words at once.
    """
    raw = np.frombuffer("".join([f"<{w}>" for w in words if w]).encode(), np.uint8)
    first = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters begin
    size = np.diff(first, append=len(raw))
    sizes = np.array([len(w) + 2 if w else 0 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(first))  # characters up to the end of the word
    at, state = np.arange(len(first)), np.full(len(first), 0xFFFFFFFF, dtype=np.uint32)
    flat, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def grown(state: np.ndarray, place: np.ndarray) -> np.ndarray:
        return _CRC[(state ^ raw[place]) & 0xFF] ^ (state >> 8)

    for n in range(1, GRAMS[-1] + 1):
        whole = left[at] >= n
        at, state = at[whole], state[whole]
        last = at + (n - 1)
        state = grown(state, first[last])
        for further in range(1, 4):
            longer = np.flatnonzero(size[last] > further)
            state[longer] = grown(state[longer], first[last[longer]] + further)
        if n in GRAMS:
            flat.append((~state & (BUCKETS - 1)).astype(np.int64))
            owners.append(owner[at])
    return np.concatenate(flat), np.concatenate(owners)


def window_starts(n: int) -> np.ndarray:
    """First words of overlapping windows that cover ``n`` words."""
    return np.unique(np.append(np.arange(0, max(1, n - WINDOW + 1), STRIDE), max(0, n - WINDOW)))


@dataclass
class ToxicityModel:
    """Value of every n-gram bucket in the linear layer, its constant, and the shift that puts the cut at one half."""

    values: np.ndarray
    constant: float
    shift: float = 0.0
    fixed: float | None = None  # score of everything where nothing could be learnt

    def scores(self, margins: list[float]) -> np.ndarray:
        return sigmoid(np.array(margins) + self.shift) if self.fixed is None else np.full(len(margins), self.fixed)


class Scorer:
    """Scores texts; remembers the values of up to ``KNOWN_WORDS`` words."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > KNOWN_WORDS:
            self.known.clear()
        cores = {w: core(w) for w in words}
        distinct = list(set(cores.values()))
        flat, owner = all_grams(distinct)
        sizes = np.bincount(owner, minlength=len(distinct))
        total = np.bincount(owner, weights=self.model.values[flat], minlength=len(distinct))
        values = dict(zip(distinct, (total / np.maximum(sizes, 1)).tolist(), strict=True))
        self.known.update((w, values[c]) for w, c in cores.items())

    def logits(self, texts: list[str | None]) -> list[tuple[float, int]]:
        """Per text the largest window logit, before the final shift, and where that window starts."""
        out = []
        split = [(t or "").split() for t in texts]
        fresh = {w for words in split for w in words if w not in self.known}
        if fresh:
            self._learn(fresh)
            missing = {w for words in split for w in words if w not in self.known}
            if missing:  # the memory was cleared meanwhile
                self._learn(missing)
        get = self.known.__getitem__
        for words in split:
            n = len(words)
            if not n:
                out.append((self.model.constant, 0))
                continue
            values = np.fromiter(map(get, words), np.float64, n)
            values[1:][values[1:] == values[:-1]] = 0.0  # a word said over and over counts once in a row
            sums = np.concatenate([[0.0], np.cumsum(values)])
            starts = window_starts(n)
            stops = np.minimum(starts + WINDOW, n)
            means = (sums[stops] - sums[starts]) / (stops - starts)
            best = int(means.argmax())
            out.append((float(self.model.constant + SCALE * means[best]), int(starts[best])))
        return out


class Bags:
    """The words of sampled documents as n-gram buckets, and the overlapping windows of each document."""

    def __init__(self, texts: list[str]) -> None:
        vocabulary: dict[str, int] = {}
        blank = vocabulary.setdefault("", 0)
        docs = [np.array([vocabulary.setdefault(core(w), len(vocabulary)) for w in t.split()], dtype=np.int32) for t in texts]
        for words in docs:
            words[1:][words[1:] == words[:-1]] = blank  # a word said over and over counts once in a row
        sizes = np.array([len(d) for d in docs])
        self.words = np.concatenate(docs)
        begins = np.cumsum(sizes) - sizes
        starts = [window_starts(n) for n in sizes.tolist()]
        self.doc = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        self.start = np.concatenate(starts) + begins[self.doc]
        self.stop = np.minimum(self.start + WINDOW, (begins + sizes)[self.doc])
        listed, parts, gram_sizes = list(vocabulary), [], []
        for some in (listed[i:i + 20_000] for i in range(0, len(listed), 20_000)):
            found, owner = all_grams(some)
            parts.append(found[np.argsort(owner, kind="stable")].astype(np.int32))
            gram_sizes.append(np.bincount(owner, minlength=len(some)).astype(np.int32))
        self.gram_sizes, flat = np.concatenate(gram_sizes), np.concatenate(parts)
        of_word = np.repeat(np.arange(len(listed), dtype=np.int32), self.gram_sizes)
        seen_in = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(listed))
        common = np.bincount(flat, weights=seen_in[of_word], minlength=BUCKETS) >= COMMON
        keep = common[flat]  # what few documents have would only be learnt by heart
        self.flat, self.of_word = flat[keep], of_word[keep]

    def word_values(self, values: np.ndarray) -> np.ndarray:
        total = np.bincount(self.of_word, weights=values[self.flat], minlength=len(self.gram_sizes))
        return total / np.maximum(self.gram_sizes, 1)

    def means(self, values: np.ndarray) -> np.ndarray:
        """Mean value of the words of every window."""
        sums = np.concatenate([[0.0], np.cumsum(self.word_values(values)[self.words])])
        return (sums[self.stop] - sums[self.start]) / (self.stop - self.start)


class SoftmaxOverBags:
    """Embeddings and softmax layer, trained together by Adam on whole sets of windows."""

    def __init__(self, bags: Bags, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.bags = bags
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.layer = rng.normal(0, 0.5, (DIM, 2))
        self.constant = np.zeros(2)
        self.moments = [[np.zeros(p.shape), np.zeros(p.shape)] for p in (self.embedding, self.layer, self.constant)]
        self.steps = 0

    def values(self) -> np.ndarray:
        """What one occurrence of each bucket adds to the logit of the second class."""
        learnt = np.zeros(BUCKETS, dtype=np.float32)
        used = np.unique(self.bags.flat)
        learnt[used] = self.embedding[used] @ (self.layer[:, 1] - self.layer[:, 0])
        return learnt

    def fit(self, windows: np.ndarray, toxic: np.ndarray, steps: int, rate: float = 0.05, decay: float = 2e-6) -> None:
        bags = self.bags
        sizes = bags.stop[windows] - bags.start[windows]
        of_window = np.repeat(np.arange(len(windows)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bags.start[windows], sizes)
        words, flat = np.unique(bags.words[at], return_inverse=True)
        place = np.full(len(bags.gram_sizes), -1)
        place[words] = np.arange(len(words))
        mine = place[bags.of_word] >= 0
        of_word, (used, gram) = place[bags.of_word[mine]], np.unique(bags.flat[mine], return_inverse=True)
        per_word, per_window = 1.0 / np.maximum(bags.gram_sizes[words], 1)[:, None], SCALE / sizes[:, None]
        target = np.stack([1 - toxic, toxic], axis=1).astype(float)
        weight = (np.where(toxic == 1, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1)))[:, None]

        def added(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
            return np.stack([np.bincount(owner, weights=rows[:, d], minlength=n) for d in range(rows.shape[1])], axis=1)

        for _ in range(steps):
            self.steps += 1
            vectors = added(self.embedding[used[gram]], of_word, len(words)) * per_word
            means = added(vectors[flat], of_window, len(windows)) * per_window
            logits = means @ self.layer + self.constant
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - target) * weight
            down = added((error @ self.layer.T * per_window)[of_window], flat, len(words)) * per_word
            gradients = (added(down[of_word], gram, len(used)) + decay * self.embedding[used], means.T @ error, error.sum(axis=0))
            for k, (parameter, g) in enumerate(zip((self.embedding, self.layer, self.constant), gradients, strict=True)):
                rows = used if k == 0 else slice(None)
                m, v = self.moments[k]
                m[rows] += 0.1 * (g - m[rows])
                v[rows] += 0.01 * (g * g - v[rows])
                step = m[rows] / (1 - 0.9**self.steps) / (np.sqrt(v[rows] / (1 - 0.99**self.steps)) + 1e-9)
                parameter[rows] -= (rate * step).astype(parameter.dtype)


def train(texts: list[str], toxic: np.ndarray, first_steps: int = 40, steps: int = 15, rounds: int = 5, settled: float = 0.99,
          seed: int = 3) -> ToxicityModel:
    """Train on windows of texts (none without words) whose labels hold for the whole text.

    The first round takes windows of each text at random. Later ones take, by the model so far,
    the most toxic window of each toxic text, where the cause of its label is most likely, and the
    most toxic windows of each clean text, which must not decide for toxic. Rounds end when the
    share ``settled`` of the toxic texts keep their window, or after ``rounds``; a long first round makes
    what is learnt hang less on the first draw.
    """
    bags = Bags(texts)
    model = SoftmaxOverBags(bags, seed)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags.doc))
    before = None
    for turn in range(rounds):
        if turn:
            order = np.argsort(-bags.means(model.values()), kind="stable")
        by_doc = order[np.argsort(bags.doc[order], kind="stable")]
        owner = bags.doc[by_doc]
        first = np.searchsorted(owner, owner)
        place = np.arange(len(owner)) - first
        most = np.where(toxic[owner] == 1, 1 if turn else TOXIC_WINDOWS, CLEAN_WINDOWS)
        chosen = by_doc[place < most]
        decisive = chosen[toxic[bags.doc[chosen]] == 1]
        if turn > 1 and np.mean(decisive == before) >= settled:
            break
        before = decisive
        model.fit(chosen, toxic[bags.doc[chosen]], steps if turn else first_steps)
    return ToxicityModel(model.values(), float(model.constant[1] - model.constant[0]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> ToxicityModel:
    """Learn from a bounded sample of labelled documents that are not held out.

    The driver gets the texts of at most ``toxic_docs + clean_docs`` documents. Without labels of
    both kinds every score is the share of toxic labels (zero without any).
    """
    sample = labelled_sample(docs, labels, "toxic", {1: toxic_docs, 0: clean_docs}, id_col, text_col)
    learnt = sample.where(F.col("turn") >= CALIBRATION).orderBy("doc_id", "text").toPandas()
    worded = learnt[learnt["text"].fillna("").str.strip() != ""]
    if worded["label"].nunique() < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 0.0, fixed=float(np.average(learnt["label"], weights=learnt["weight"])) if len(learnt) else 0.0)
    model = train(worded["text"].tolist(), worded["label"].to_numpy())

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([m for m, _ in scorer.logits(batch.column(0).to_pylist())], pa.float64()), *batch.columns[1:]], ["margin", "label", "weight"])

    seen = sample.where(F.col("turn") < CALIBRATION).select("text", "label", "weight").mapInArrow(
        margins, "margin double, label int, weight double").toPandas()
    if seen["label"].nunique() == 2:
        usual = learnt.groupby("label")["weight"].sum().add(seen.groupby("label")["weight"].sum(), fill_value=0)
        weight = seen["label"].map(usual / seen["label"].value_counts()).to_numpy()
        model.shift = -best_cut(seen["margin"].to_numpy(), seen["label"].to_numpy(), weight)
    return model


def best_cut(margins: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The margin from which on calling a text toxic gives the best F1, as classes are usually mixed."""
    order = np.argsort(-margins, kind="stable")
    hits, alarms = np.cumsum((weight * toxic)[order]), np.cumsum((weight * (1 - toxic))[order])
    f1 = 2 * hits / (hits + alarms + (weight * toxic).sum())
    f1[np.append(np.diff(margins[order]) == 0, False)] = -1  # equal margins stay together
    best = int(f1.argmax())
    after = margins[order][min(best + 1, len(order) - 1)]
    return float((margins[order][best] + after) / 2)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and ``worst_word`` (first word of the most toxic window) of every row.

    Only the text is an input of the score. Null and empty texts, and those of white space only,
    get the score of a text without any n-gram. Rows that repeat are scored alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = scorer.logits(part.column(1).to_pylist())
                score = model.scores([m for m, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([w for _, w in found], pa.int32())],
                    ["doc_id", "score", "predicted", "worst_word"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED)


def harmless_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents that the model does not call toxic, with all their columns."""

    def prepare():
        scorer = Scorer(model)
        return lambda texts: model.scores([m for m, _ in scorer.logits(texts)]) < 0.5

    return keep_rows(docs, [text_col], prepare)


@named("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "worst_word")
