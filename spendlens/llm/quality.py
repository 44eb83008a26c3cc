"""Quality by co-training: a text-content and a page-metadata classifier teach each other.

The content view sees what words look like and how they repeat; the metadata view sees language,
source, stated length and the layout of the page. Both start from the same labelled sample. In
each round, either names the unlabelled pages it is surest of, and these join the other's labels.
Labelled documents set apart put both on a scale of probabilities and weigh their sum, which
scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from spendlens.llm.learning import held_out, keep_rows, labelled_sample, logistic, sigmoid
from spendlens.llm.shared import in_parts, named, stored, table

SHAPES = 192
CONTENT = SHAPES + 8
CATEGORIES = 48
METADATA = 2 * CATEGORIES + 9
#: Labelled documents learnt from at most (good, poor), and how many pseudo-labels of each kind a
#: view gives the other per round.
GOOD_DOCS, POOR_DOCS, GIVEN, ROUNDS = 3000, 3000, 150, 4
#: Of every thousand sampled documents, so many set the scales instead.
CALIBRATION = 250
KNOWN_WORDS = 350_000
SCORED = "doc_id long, score double, predicted int, content_score double, metadata_score double"


def shape(word: str) -> int:
    """Bucket of what a word looks like: runs of capitals, small letters and digits, and its signs."""
    out: list[str] = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return crc32("".join(out).encode()) % SHAPES


class Views:
    """Features of both views; remembers shapes and lengths of up to ``KNOWN_WORDS`` words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def content(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        out = np.zeros(CONTENT)
        if not words:
            return out
        n = len(words)
        known = self.known
        distinct = set(words)
        fresh = [w for w in distinct if w not in known]
        if fresh:
            if len(known) + len(fresh) > KNOWN_WORDS:
                known.clear()
                fresh = distinct
            known.update((w, shape(w)) for w in fresh)
        out[:SHAPES] = np.sqrt(np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, n), minlength=SHAPES) / n)
        lines = (text or "").split("\n")
        repeats = sum(map(str.__eq__, words[1:], words[:-1]))
        out[SHAPES:] = (len(distinct) / n, repeats / n, len(text) / n / 10, len(set(lines)) / len(lines),
                        min(n, 1000) / 1000, np.log1p(n) / 10, float(n < 5), np.log1p(len(distinct)) / 10)
        return out

    @staticmethod
    def metadata(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
        text = text or ""
        out = np.zeros(METADATA)
        out[crc32(f"lang {lang}".encode()) % CATEGORIES] = 1
        out[CATEGORIES + crc32(f"source {source}".encode()) % CATEGORIES] = 1
        raw = np.frombuffer(text.encode(), np.uint8)
        size = len(raw) or 1
        _, capitals, signs, blanks, breaks = np.bincount(_KINDS[raw], minlength=5).tolist()
        lines = breaks + 1
        out[2 * CATEGORIES:] = (np.log1p(max(n_chars or 0, 0)) / 10, float(n_chars is None), np.log1p(size / lines) / 10, np.log1p(lines) / 10,
                                blanks / size, capitals / size, signs / size, np.sqrt(signs / size), float(lang is None) + float(source is None))
        return out


#: Per byte: 1 capital A-Z, 2 ASCII sign, 3 blank, 4 line break, else 0.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[33:127] = [0 if chr(c).isalnum() else 2 for c in range(33, 127)]
_KINDS[65:91], _KINDS[32], _KINDS[10] = 1, 3, 4


@dataclass
class QualityModel:
    """Weights of both views, of their scales, and of their sum."""

    content: np.ndarray
    metadata: np.ndarray
    scales: tuple[np.ndarray, np.ndarray]
    mix: np.ndarray
    fixed: float | None = None

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content and metadata probability of good quality."""
        if self.fixed is not None:
            same = np.full(len(content), self.fixed)
            return same, same, same
        margins = [with_one(x) @ w for x, w in ((content, self.content), (metadata, self.metadata))]
        scaled = [with_one(m[:, None]) @ s for m, s in zip(margins, self.scales, strict=True)]
        return sigmoid(with_one(np.clip(np.stack(scaled, axis=1), -20, 20)) @ self.mix), sigmoid(scaled[0]), sigmoid(scaled[1])


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Margins row by row, so that a row's margin does not depend on the rows beside it."""
    return (x * w[:-1]).sum(axis=1) + w[-1]


#: Kinds of pseudo-labels in the order they are taken: (view, label).
KINDS = ((0, 0), (0, 1), (1, 0), (1, 1))


def sure_enough(margins: np.ndarray, label: int) -> np.ndarray:
    return sigmoid(margins) >= 0.95 if label else sigmoid(margins) <= 0.05


def wanted(view: int, given: int) -> int:
    """How many candidates of a kind are enough: the other view takes its own first, of the same rows perhaps."""
    return given if view == 0 else 3 * given


def surest_rows(sure: np.ndarray, at: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` surest distinct keys, equally sure ones by ``at``."""
    first = np.unique(keys, return_index=True)[1]
    return first[np.lexsort((keys[first], at[first], -sure[first]))[:most]]


@dataclass
class ArrayPool:
    """Unlabelled rows as two arrays, one row per document."""

    views: tuple[np.ndarray, np.ndarray]

    def __post_init__(self) -> None:
        self.free = np.ones(len(self.views[0]), dtype=bool)

    def surest(self, weights: list[np.ndarray], given: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both views' features of what each kind takes; those rows take no part in later rounds."""
        taken = []
        for view, label in KINDS:
            margins = margin(self.views[view], weights[view])
            at = np.flatnonzero(self.free & sure_enough(margins, label))
            rows = at[np.argsort(-margins[at] if label else margins[at], kind="stable")][:given]
            self.free[rows] = False
            taken.append((self.views[0][rows], self.views[1][rows]))
        return taken


class StoredPool:
    """All unlabelled documents, their features on shared storage; each round scores every one of them on Spark.

    Equally sure documents are taken by id, so the choice does not depend on how the rows are split.
    Only the rows taken go to the driver.
    """

    COLUMNS = ("at", "key", "content", "metadata")
    SCHEMA = "view int, label int, sure double, at long, key long, content binary, metadata binary"

    def __init__(self, docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> None:
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), "lang", "source", "n_chars")
        free = texts.join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_anti")
        # rows without id come first; of rows alike in id and features one is taken for all
        self.rows = stored(featured(free, ["doc_id"], "text", packed=True).select(
            F.coalesce("doc_id", F.lit(-(2**63))).alias("at"), F.xxhash64("doc_id", "content", "metadata").alias("key"), "content", "metadata"))
        self.used: list[int] = []

    def surest(self, weights: list[np.ndarray], given: int) -> list[tuple[np.ndarray, np.ndarray]]:
        used = np.array(self.used, dtype=np.int64)
        columns, schema = self.COLUMNS, self.SCHEMA

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], pa.Table] = {}
            for batch in batches:
                batch = batch.filter(pa.array(~np.isin(batch.column("key").to_numpy(), used)))
                if not batch.num_rows:
                    continue
                margins = [margin(unpacked(batch.column(c), n), w) for c, n, w in zip(columns[2:], (CONTENT, METADATA), weights, strict=True)]
                ids, keys = (batch.column(c).to_numpy() for c in columns[:2])
                for view, label in KINDS:
                    at = np.flatnonzero(sure_enough(margins[view], label))
                    sure = margins[view][at] * (1 if label else -1)
                    top = surest_rows(sure, ids[at], keys[at], wanted(view, given))
                    rows = pa.table({"sure": sure[top], **{c: batch.column(c).take(pa.array(at[top])) for c in columns}})
                    if (view, label) in best:
                        rows = pa.concat_tables([best[view, label], rows])
                        rows = rows.take(pa.array(surest_rows(*(rows[c].to_numpy() for c in ("sure", "at", "key")), wanted(view, given))))
                    best[view, label] = rows.combine_chunks()
            for (view, label), rows in best.items():
                for part in rows.to_batches():
                    same = [pa.array(np.full(part.num_rows, v, dtype=np.int32)) for v in (view, label)]
                    yield pa.RecordBatch.from_arrays([*same, *part.columns], ["view", "label", *part.schema.names])

        found = stored(self.rows.mapInArrow(run, schema))
        taken = []
        mine: set[int] = set()
        for view, label in KINDS:
            rows = found.where((F.col("view") == view) & (F.col("label") == label)).dropDuplicates(["key"]).orderBy(
                F.desc("sure"), "at", "key").limit(wanted(view, given)).collect()
            rows = [r for r in rows if r["key"] not in mine][:given]
            mine.update(r["key"] for r in rows)
            taken.append(tuple(np.frombuffer(b"".join(r[c] for r in rows), np.float32).reshape(len(rows), n).astype(float)
                               for c, n in (("content", CONTENT), ("metadata", METADATA))))
        self.used += sorted(mine)
        return taken


def unpacked(column: pa.Array, n: int) -> np.ndarray:
    """Rows of a column of packed features."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), n).astype(float)


def co_train(labelled: tuple[np.ndarray, ...], pool: tuple[np.ndarray, np.ndarray] | ArrayPool | StoredPool,
             scale: tuple[np.ndarray, ...], rounds: int = ROUNDS, given: int = GIVEN) -> QualityModel:
    """Train both views on ``labelled`` and each other's surest pseudo-labels from ``pool``; fit scales on ``scale``.

    ``labelled`` and ``scale`` are both views, labels and, where classes were sampled unevenly, how
    much each row counts (one on average); a pseudo-label counts one.
    """
    pool = ArrayPool(pool) if isinstance(pool, tuple) else pool
    views = [[labelled[v]] for v in (0, 1)]
    targets = [[labelled[2]] for _ in (0, 1)]
    counts, scale_counts = (rows[3] if len(rows) > 3 else np.ones(len(rows[2])) for rows in (labelled, scale))
    weights = [logistic(labelled[v], labelled[2], ridge=0.05, weight=counts) for v in (0, 1)]
    for _ in range(rounds):
        taken = pool.surest(weights, given)
        if not any(len(rows[0]) for rows in taken):
            break
        for (giver, label), rows in zip(KINDS, taken, strict=True):
            views[1 - giver].append(rows[1 - giver])
            targets[1 - giver].append(np.full(len(rows[0]), label))
        weights = [logistic(np.concatenate(views[v]), y := np.concatenate(targets[v]), ridge=0.05,
                            weight=np.append(counts, np.ones(len(y) - len(counts)))) for v in (0, 1)]
    margins = [with_one(scale[v]) @ weights[v] for v in (0, 1)]
    scales = tuple(logistic(m[:, None], scale[2], ridge=1e-3, weight=scale_counts) for m in margins)
    both = np.clip(np.stack([with_one(m[:, None]) @ s for m, s in zip(margins, scales, strict=True)], axis=1), -20, 20)
    return QualityModel(weights[0], weights[1], scales, logistic(both, scale[2], ridge=1e-3, weight=scale_counts))


def featured(docs: DataFrame, keep: list[str], text_col: str, packed: bool = False) -> DataFrame:
    """Columns ``keep`` and both views' features as doubles, or ``packed`` as the bytes of floats."""
    kind = BinaryType() if packed else ArrayType(DoubleType())
    schema = docs.select(*keep).schema.add("content", kind).add("metadata", kind)

    def cells(rows: list[np.ndarray]) -> pa.Array:
        return pa.array([r.astype(np.float32).tobytes() for r in rows], pa.binary()) if packed else pa.array(rows, pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = Views()
        for batch in in_parts(batches):
            columns = [batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")]
            content = [views.content(t) for t in columns[0]]
            metadata = [views.metadata(*row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"_{c}") for c in keep), cells(content), cells(metadata)], [*keep, "content", "metadata"])

    return docs.select(*[F.col(c).alias(f"_{c}") for c in keep], F.col(text_col).alias("text"), "lang", "source",
                       F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                good_docs: int = GOOD_DOCS, poor_docs: int = POOR_DOCS) -> QualityModel:
    """Co-train on a bounded sample of labelled documents that are not held out, and on all other documents without their labels.

    Sampled labels count for all of their class, so a score means the same however many labels
    there are. Without labels of both kinds (after some were set apart for the scales), every score
    is the share of good labels, one without any.
    """
    sample = labelled_sample(docs, labels, "quality", {1: good_docs, 0: poor_docs}, id_col, text_col, ("lang", "source", "n_chars"))
    got = featured(sample, ["doc_id", "label", "turn", "weight"], "text").toPandas()
    got = got.assign(**{c: got[c].map(tuple) for c in ("content", "metadata")}).sort_values(
        ["turn", "label", "doc_id", "content", "metadata"], kind="stable")
    content, metadata = (np.array(got[c].tolist()).reshape(len(got), n) for c, n in (("content", CONTENT), ("metadata", METADATA)))
    label, learn, weight = got["label"].to_numpy(), (got["turn"] >= CALIBRATION).to_numpy(), got["weight"].to_numpy()
    if len(set(label[learn])) < 2 or len(set(label[~learn])) < 2:
        return QualityModel(np.zeros(0), np.zeros(0), (np.zeros(0), np.zeros(0)), np.zeros(0), fixed=float(np.average(label, weights=weight)) if len(label) else 1.0)
    labelled, scale = ((content[at], metadata[at], label[at], weight[at] / weight[at].mean()) for at in (learn, ~learn))
    return co_train(labelled, StoredPool(docs, sample, id_col, text_col), scale)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (probability of good quality), ``predicted`` and both views' scores of every row.

    Null texts count as empty; null language, source and length are values of their own. Rows that
    repeat are scored alike. Columns other than id, text, lang, source and n_chars are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = Views()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                columns = [part.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")]
                content = np.stack([views.content(t) for t in columns[0]])
                metadata = np.stack([views.metadata(*row) for row in zip(*columns, strict=True)])
                score, by_content, by_metadata = model.scores(content, metadata)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(by_content), pa.array(by_metadata)],
                    ["doc_id", "score", "predicted", "content_score", "metadata_score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), "lang", "source",
                       F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(run, SCORED)


def good_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""

    def prepare():
        views = Views()
        return lambda *columns: model.scores(np.stack([views.content(t) for t in columns[0]]),
                                             np.stack([views.metadata(*row) for row in zip(*columns, strict=True)]))[0] >= 0.5

    return keep_rows(docs, ["text", "lang", "source", "n_chars"], prepare)


@named("op5_co_training")
def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, 1 for those to keep."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
