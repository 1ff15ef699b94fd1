"""Toxicity by a chain of linear classifiers."""

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import lean
from .words import text_batches, word_hashes

#: Labelled rows that the chain is fitted on, about, at any size of input; rows of every category among them, if there are so many; words it may weigh; and folds.
SAMPLE, EACH, FEATURES, FOLDS = 12_000, 1_000, 1024, 5
#: Categories in the order of the chain: a column of the labels table, and the value that means yes.
CATEGORIES = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}
_TABLE_BITS = 22


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anything, ..., text last) to the same with the text's distinct word hashes as bytes."""
    for batch in batches:
        out = []
        for _, raw, ends in text_batches(batch.column(batch.num_columns - 1)):
            words, first = word_hashes(raw, ends)
            out += [np.unique(words[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], batch.schema.names)


def fit_logistic(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, features: int, penalty: float = 1.0) -> np.ndarray:
    """Weights of ``features`` words (present in ``rows`` at ``cols``), then of the columns of ``extra``, then the bias: ridge logistic regression by Newton steps, each solved by conjugate gradients."""
    n, k = len(y), extra.shape[1]
    pull = np.r_[np.full(features + k, penalty), 1e-6]

    def times(w):
        return np.bincount(rows, w[cols], n) + extra @ w[features:-1] + w[-1]

    def back(v):
        return np.r_[np.bincount(cols, v[rows], features), extra.T @ v, v.sum()]

    w = np.zeros(features + k + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for _ in range(10):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        grad = back(p - y) + pull * w
        curve = np.maximum(p * (1 - p), 1e-6)
        step, rest = np.zeros_like(w), grad.copy()
        way, norm = rest.copy(), rest @ rest
        for _ in range(15):
            if norm < 1e-10:
                break
            bent = back(curve * times(way)) + pull * way
            a = norm / (way @ bent)
            step += a * way
            rest -= a * bent
            fresh = rest @ rest
            way, norm = rest + fresh / norm * way, fresh
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


@dataclass
class Chain:
    """Word hashes in order, their weights per category, weights of earlier categories' probabilities, biases, and the thresholds of yes."""

    names: list[str]
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray
    threshold: np.ndarray
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def predict(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities (rows, categories) of texts in one run of bytes."""
        if self.table is None:
            self.table = np.zeros(1 << _TABLE_BITS, bool)
            self.table[(self.words >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        n = len(ends) - 1
        words, first = word_hashes(raw, ends)
        at = np.flatnonzero(self.table[(words >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        place = np.searchsorted(self.words, words[at]) if len(self.words) else at
        hit = np.zeros(len(at), bool) if not len(self.words) else self.words[np.minimum(place, len(self.words) - 1)] == words[at]
        row = np.searchsorted(first, at[hit], "right") - 1
        pairs = np.unique(row * max(1, len(self.words)) + place[hit])
        row, col = np.divmod(pairs, max(1, len(self.words)))
        return self.chained([np.bincount(row, self.weights[j][col], n) for j in range(len(self.names))], n)

    def chained(self, sums: list[np.ndarray], n: int) -> np.ndarray:
        p = np.zeros((n, len(self.names)))
        for j in range(len(self.names)):
            p[:, j] = 1 / (1 + np.exp(-np.clip(sums[j] + p[:, :j] @ self.earlier[j, :j] + self.bias[j], -30, 30)))
        return p


def _best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the best F1 of weighted rows, halfway to the next lower probability; over 1 if there is no yes."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((y * weight)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + hits[-1])
    last = np.r_[p[order][1:] != p[order][:-1], True]
    i = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order[i]] + (p[order[i + 1]] if i + 1 < len(y) else 0.0)) / 2)


def _chosen(row: np.ndarray, col: np.ndarray, n_words: int, labels: np.ndarray, use: np.ndarray, features: int) -> np.ndarray:
    """The words, rising, whose share among the rows in ``use`` differs by category the most: in 5 of them at least, by 3 standard errors at least."""
    pick = use[row]
    row, col = row[pick], col[pick]
    best = np.zeros(n_words)
    for j in range(labels.shape[1]):
        known = use & ~np.isnan(labels[:, j])
        yes = known & (labels[:, j] == 1)
        a, b = yes.sum(), (known & ~yes).sum()
        if a and b:
            inside, all_ = np.bincount(col, yes[row], n_words), np.bincount(col, known[row], n_words)
            share = all_ / (a + b)
            best = np.maximum(best, np.abs(inside / a - (all_ - inside) / b) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / a + 1 / b)))
    best[np.bincount(col, minlength=n_words) < 5] = 0
    chosen = np.sort(np.argsort(-best, kind="stable")[:features])
    return chosen[best[chosen] > 3]


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, names: list[str], weight: np.ndarray | None = None, features: int = FEATURES, folds: int = FOLDS) -> tuple[Chain, np.ndarray]:
    """A chain over documents (distinct word hashes each) with labels (rows, categories; 0, 1, or nan: unknown), and its out-of-fold probabilities.

    The words weighed are those in 5 documents or more, ``features`` of them at most, whose share differs by category the most.
    A later category's model gets the earlier ones' probabilities as inputs; in training those
    come from models that did not see the row, in ``folds`` folds: neither their weights nor their
    choice of words. ``weight`` is how many rows a row stands for; it counts in the thresholds.
    """
    n, k = labels.shape
    weight = np.ones(n) if weight is None else weight
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    words, col = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    fold = np.random.default_rng(7).integers(0, folds, n)

    def sparse(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words chosen from the rows in ``use``, and where they are in all rows."""
        chosen = _chosen(row, col, len(words), labels, use, features)
        slot = np.full(len(words) + 1, -1)
        slot[chosen] = np.arange(len(chosen))
        keep = slot[col] >= 0
        return chosen, row[keep], slot[col[keep]]

    whole, parts = sparse(np.ones(n, bool)), [sparse(fold != f) for f in range(folds)]
    m = len(whole[0])
    outside = np.zeros((n, k))
    chain = Chain(list(names), words[whole[0]], np.zeros((k, m)), np.zeros((k, k)), np.zeros(k), np.full(k, 2.0))
    for j in range(k):
        known = ~np.isnan(labels[:, j])

        def fitted(part, use, j=j):
            chosen, row, col = part
            if not use.any():
                return np.zeros(len(chosen) + j + 1)
            back = np.cumsum(use) - 1
            pick = use[row]
            return fit_logistic(back[row[pick]], col[pick], outside[use, :j], labels[use, j], len(chosen))

        for f, part in enumerate(parts):
            w = fitted(part, known & (fold != f))
            there, size = fold == f, len(part[0])
            z = np.bincount(part[1], w[:size][part[2]], n) + outside[:, :j] @ w[size:-1] + w[-1]
            outside[there, j] = 1 / (1 + np.exp(-np.clip(z[there], -30, 30)))
        w = fitted(whole, known)
        chain.weights[j], chain.earlier[j, :j], chain.bias[j] = w[:m], w[m:-1], w[-1]
        if known.any():
            chain.threshold[j] = _best_threshold(outside[known, j], labels[known, j] == 1, weight[known])
    return chain, outside


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: dict = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """A chain fitted on about ``sample`` labelled documents, drawn by a hash of the id; all labelled ones if there are fewer.

    Of every category about EACH rows are drawn at least, so a rare one is not lost; they count for less in the thresholds.
    A null label says nothing of its category. Labels without a document, and null ids, are
    passed over; a document with several labels counts with each. With no labels at all every
    probability is a half and nothing is toxic.
    """
    columns = [F.when(F.col(c).isNotNull(), (F.col(c) == v).cast("double")).alias(f"label{i}") for i, (c, v) in enumerate(categories.values())]
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *columns)
    totals = known.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(f"label{i}"), F.lit(0.0)) for i in range(len(columns))]).first()
    share = min(1.0, sample / max(1, totals[0]))
    shares = [F.when(F.col(f"label{i}") == 1, min(1.0, max(share, EACH / max(1.0, n)))) for i, n in enumerate(totals[1:])]
    drawn = known.withColumn("share", F.greatest(F.lit(share), F.lit(share), *shares))
    drawn = drawn.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < F.floor(F.col("share") * (1 << 30))).withColumn("weight", share / F.col("share")).drop("share")
    # about SAMPLE rows of a few numbers: small by construction
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), "id")
    rows = rows.select("id", "weight", *[f"label{i}" for i in range(len(columns))], "text")
    kind = "id long, weight double, " + ", ".join(f"label{i} double" for i in range(len(columns))) + ", words binary"
    names = list(categories)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        got = got.sort_by([("id", "ascending"), ("words", "ascending")])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in got["words"]]
        table = np.column_stack([got[f"label{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_chain(sets, table, names, got["weight"].to_numpy())[0])])], ["chain"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from fit(itertools.chain([first], batches))

    # the sample is bounded, so one task holds it; the driver gets weights only
    found = rows.mapInArrow(lean(_distinct_words), kind).repartition(1).mapInArrow(lean(fitted), "chain binary").collect()
    return pickle.loads(found[0][0]) if found else fit_chain([], np.zeros((0, len(names))), names)[0]


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category> ..., toxic): probabilities of every row's whole text, and whether the last category's passes its threshold. Null and empty texts have no words: the biases decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate([np.zeros((0, len(chain.names))), *[chain.predict(raw, ends) for _, raw, ends in text_batches(batch.column(1))]])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p.T.copy()), pa.array(p[:, -1] >= chain.threshold[-1])], ["id", *[f"p_{x}" for x in chain.names], "toxic"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"p_{x} double" for x in chain.names) + ", toxic boolean"
    return rows.mapInArrow(lean(run), kind).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are toxic; all columns stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate([np.zeros((0, len(chain.names))), *[chain.predict(raw, ends) for _, raw, ends in text_batches(batch.column(at))]])
            yield batch.filter(pa.array(p[:, -1] < chain.threshold[-1]))

    return docs.mapInArrow(lean(run), docs.schema)
