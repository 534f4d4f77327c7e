"""Document quality by co-training a text view and a metadata view."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import blocks, by_text, find_words, free_memory, in_one_task, range_hashes

#: Bounds of the fitting sample: labelled documents, unlabelled ones, bytes of a text.
LABELLED, UNLABELLED, SAMPLE_BYTES = 6_000, 2_000, 30_000
#: Hashed words and word beginnings, and how many of them a text view may use.
BUCKETS, CHOSEN = 1 << 16, 1024
#: Least chi-square of a chosen bucket: few of the buckets reach it by chance.
TELLING = 20.0
HEAD = 6  # bytes of a word's beginning
#: Numbers become bins; the tails are cut finer, since junk is rare.
CUTS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.88, 0.92, 0.95, 0.97, 0.985])
BINS = len(CUTS) + 1
ROUNDS, CONFIDENT, ADDED = 3, 0.95, 200
#: Part of the labelled sample that only calibrates.
HELD_OUT = 5
ACCEPT = 0.5

SHAPES = ["upper", "digit", "blank", "stop", "cry", "sign", "high"]
_SHAPE = np.zeros(256, dtype=np.uint8)
for _n, _chars in enumerate(
    (
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        b"0123456789",
        b" \t\n\r\x0b\x0c",
        b".,;:'\"-()",
        b"?!",
        b"#$%&*+/<=>@[\\]^_`{|}~",
    ),
    1,
):
    _SHAPE[list(_chars)] = _n
_SHAPE[128:] = 7

TEXT_NUMBERS = ["repeated", "word_length", "stop", "cry", "sign", "upper"]
PAGE_NUMBERS = ["size", "lines", "line_length", "blank", "digit", "stop", "cry", "sign", "upper"]
PAGE_NUMBERS += ["n_chars"]


def text_features(data: bytes, offsets: np.ndarray):
    """Word and word-beginning buckets with their texts, and a table of numbers per text."""
    low, starts, ends, hashes, at = find_words(data, offsets)
    heads = range_hashes(low, starts, np.minimum(ends, starts + HEAD)) ^ np.uint64(0x5BD1E995)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    size = np.diff(offsets)
    raw = np.frombuffer(data, dtype=np.uint8)
    text = np.repeat(np.arange(n), size)
    shapes = np.bincount(text * 8 + _SHAPE[raw], minlength=8 * n).reshape(n, 8)
    lines = np.bincount(text[raw == 10], minlength=n) + 1
    words = np.maximum(np.diff(at), 1)
    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    numbers = {name: shapes[:, i] / np.maximum(size, 1) for i, name in enumerate(SHAPES, 1)}
    numbers["repeated"] = np.bincount(owner[1:][same], minlength=n) / words
    numbers["word_length"] = np.bincount(owner, weights=ends - starts, minlength=n) / words
    numbers["size"] = np.log1p(size)
    numbers["lines"] = np.log1p(lines)
    numbers["line_length"] = np.log1p(size / lines)
    mask = np.uint64(BUCKETS - 1)
    buckets = np.concatenate((hashes & mask, heads & mask)).astype(np.int64)
    return np.concatenate((owner, owner)), buckets, numbers


def _distinct(owner: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(owner * BUCKETS + buckets)
    return pairs // BUCKETS, pairs % BUCKETS


def metadata(frame: pd.DataFrame) -> list[str]:
    """One name for each document's language and source."""
    pairs = zip(frame.lang.fillna("").astype(str), frame.source.fillna("").astype(str))
    return [f"{a}\0{b}" for a, b in pairs]


class Sparse:
    """Rows of ones: (row, column) pairs, and a logistic model on them."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]):
        order = np.argsort(rows, kind="stable")
        self.rows, self.columns, self.shape = rows[order], columns[order], shape

    def take(self, keep: np.ndarray) -> Sparse:
        place = np.full(self.shape[0], -1)
        place[keep] = np.arange(len(keep))
        own = place[self.rows] >= 0
        return Sparse(place[self.rows[own]], self.columns[own], (len(keep), self.shape[1]))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=weights[self.columns], minlength=self.shape[0])

    def fit(self, target: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> np.ndarray:
        """Weights and, last, the constant; adaptive gradient steps."""
        weights, constant = np.zeros(self.shape[1]), 0.0
        squares, constant_square = np.full(self.shape[1], 1e-8), 1e-8
        n = max(1, len(target))
        for _ in range(steps):
            slope = (sigmoid(self.times(weights) + constant) - target) / n
            grad = np.bincount(self.columns, weights=slope[self.rows], minlength=self.shape[1])
            grad += ridge * weights
            squares += grad**2
            weights -= 0.4 * grad / np.sqrt(squares)
            step = slope.sum()
            constant_square += step**2
            constant -= 0.4 * step / np.sqrt(constant_square)
        return np.append(weights, constant)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(columns: np.ndarray, target: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a logistic model of few columns; the constant comes last."""
    x = np.column_stack([columns, np.ones(len(columns))])
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ beta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        beta -= np.linalg.solve(hessian, x.T @ (p - target) + ridge * beta)
    return beta


@dataclass
class Head:
    """What scores one label: weights of both views and the calibration of their scores."""

    text_words: np.ndarray
    text_bins: np.ndarray
    page_bins: np.ndarray
    page_names: dict[str, float]
    text_constant: float
    page_constant: float
    text_scale: np.ndarray
    page_scale: np.ndarray
    joint: np.ndarray

    def probability(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        views = [s[0] * x + s[1] for s, x in ((self.text_scale, text), (self.page_scale, page))]
        return sigmoid(np.column_stack(views) @ self.joint[:2] + self.joint[2])


@dataclass
class Model:
    """Heads by label, with the bin edges of the numbers; a label of one class has its prior."""

    edges: dict[str, np.ndarray]
    heads: dict[str, Head | float]

    def plain(self) -> tuple[dict, dict]:
        heads = {k: vars(h) if isinstance(h, Head) else h for k, h in self.heads.items()}
        return self.edges, heads

    @classmethod
    def of(cls, edges: dict, heads: dict) -> Model:
        return cls(edges, {k: Head(**h) if isinstance(h, dict) else h for k, h in heads.items()})

    def score(self, data: bytes, offsets: np.ndarray, frame: pd.DataFrame) -> dict[str, np.ndarray]:
        n = len(frame)
        owner, buckets, numbers = text_features(data, offsets)
        numbers["n_chars"] = np.log1p(frame.n_chars.fillna(0).clip(lower=0).to_numpy(dtype=float))
        bins = {k: np.searchsorted(self.edges[k], numbers[k], "right") for k in self.edges}
        names = metadata(frame)
        heads = [h for h in self.heads.values() if isinstance(h, Head)]
        if heads:
            used = np.any([h.text_words != 0 for h in heads], axis=0)
            near = used[buckets]
            owner, buckets = _distinct(owner[near], buckets[near])
        found = {}
        for label, head in self.heads.items():
            if not isinstance(head, Head):
                found[label] = np.full(n, head)
                continue
            text = np.bincount(owner, weights=head.text_words[buckets], minlength=n)
            text = text + head.text_constant
            for i, name in enumerate(TEXT_NUMBERS):
                text += head.text_bins[i, bins[name]]
            page = np.array([head.page_names.get(x, 0.0) for x in names]) + head.page_constant
            for i, name in enumerate(PAGE_NUMBERS):
                page += head.page_bins[i, bins[name]]
            found[label] = head.probability(text, page)
        return found


class Telling:
    """Counts of texts by bucket, and the buckets that tell most about a label."""

    def __init__(self):
        self.total, self.ones = np.zeros(BUCKETS), np.zeros(BUCKETS)
        self.texts = self.positive = 0.0

    def add(self, rows: np.ndarray, buckets: np.ndarray, target: np.ndarray, used: np.ndarray) -> None:
        """Distinct (row, bucket) pairs of texts, of which ``used`` marks those that count."""
        known = used[rows]
        rows, buckets = rows[known], buckets[known]
        self.total += np.bincount(buckets, minlength=BUCKETS)
        self.ones += np.bincount(buckets, weights=target[rows], minlength=BUCKETS)
        self.texts += used.sum()
        self.positive += target[used].sum()

    def chosen(self) -> np.ndarray:
        """Buckets in five texts or more, by their chi-square."""
        expected = self.total * self.positive / max(self.texts, 1)
        spread = expected * (1 - self.total / (self.texts + 1)) + 1e-9
        told = np.where(self.total >= 5, (self.ones - expected) ** 2 / spread, 0)
        best = np.argsort(-told, kind="stable")[:CHOSEN]
        return best[told[best] >= TELLING]


def split_labels(target: np.ndarray) -> tuple[np.ndarray, np.ndarray] | float:
    """(documents to fit, documents to calibrate), or the prior if only one class is known."""
    known = np.flatnonzero(~np.isnan(target))
    if not len(known):
        return 0.5
    if target[known].min() == target[known].max():
        return float(target[known[0]])
    held = known[np.arange(len(known)) % HELD_OUT == 0]
    fitted = np.setdiff1d(known, held)
    for part in (held, fitted):
        if not len(part) or target[part].min() == target[part].max():
            return known, known
    return fitted, held


def fit_head(target, fitted, held, chosen, rows, buckets, bins, names) -> Head:
    """Co-training of the two views for one label (``target``: 0, 1 or not known).

    In each round both views are fitted on the true labels and on what the other has
    guessed; of the unlabelled documents each is sure about, a bounded number goes to the
    other view with the guess as its label.
    """
    labelled = ~np.isnan(target)
    target = np.nan_to_num(target)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    own = place[buckets] >= 0
    n = len(target)

    def binned(kinds: list[str], base: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.arange(n), base + i * BINS + bins[k]) for i, k in enumerate(kinds)]

    pairs = [(rows[own], place[buckets[own]]), *binned(TEXT_NUMBERS, len(chosen))]
    width = len(chosen) + len(TEXT_NUMBERS) * BINS
    text = Sparse(*(np.concatenate(x) for x in zip(*pairs)), (n, width))
    kinds = {name: i for i, name in enumerate(sorted(set(names)))}
    pairs = [(np.arange(n), np.array([kinds[x] for x in names])), *binned(PAGE_NUMBERS, len(kinds))]
    page_width = len(kinds) + len(PAGE_NUMBERS) * BINS
    page = Sparse(*(np.concatenate(x) for x in zip(*pairs)), (n, page_width))

    views = [text, page]
    lessons = [(fitted, target[fitted]), (fitted, target[fitted])]
    pool = np.flatnonzero(~labelled)
    for turn in range(ROUNDS + 1):
        weights = [v.take(ids).fit(y) for v, (ids, y) in zip(views, lessons)]
        scores = [v.times(w[:-1]) + w[-1] for v, w in zip(views, weights)]
        if turn == ROUNDS:
            break
        for mine, other in ((0, 1), (1, 0)):
            p = sigmoid(scores[mine][pool])
            sure = [np.flatnonzero(p >= CONFIDENT), np.flatnonzero(p <= 1 - CONFIDENT)]
            # as many of each class as the labelled documents have in proportion
            share = target[fitted].mean()
            for guess, part, most in ((1.0, sure[0], share), (0.0, sure[1], 1 - share)):
                order = np.argsort(-np.abs(p[part] - 0.5), kind="stable")[: int(ADDED * most) + 1]
                new = np.setdiff1d(pool[part[order]], lessons[other][0])
                lessons[other] = (
                    np.append(lessons[other][0], new),
                    np.append(lessons[other][1], np.full(len(new), guess)),
                )
    scales = [logistic(s[held][:, None], target[held]) for s in scores]
    calibrated = np.column_stack([a[0] * s + a[1] for a, s in zip(scales, scores)])
    joint = logistic(calibrated[held], target[held])
    words = np.zeros(BUCKETS)
    words[chosen] = weights[0][: len(chosen)]
    return Head(
        words,
        weights[0][len(chosen) : -1].reshape(len(TEXT_NUMBERS), BINS),
        weights[1][len(kinds) : -1].reshape(len(PAGE_NUMBERS), BINS),
        {name: float(weights[1][i]) for name, i in kinds.items()},
        float(weights[0][-1]),
        float(weights[1][-1]),
        scales[0],
        scales[1],
        joint,
    )


def fit(sample: pd.DataFrame, labels: list[str]) -> Model:
    """Model from a sample (text, lang, source, n_chars, and each label as 0, 1 or null)."""
    if not len(sample):
        return Model({}, dict.fromkeys(labels, 0.5))
    texts = pa.array(sample.text, pa.string())
    targets = {x: sample[x].to_numpy(dtype=float) for x in labels}
    heads: dict[str, Head | float] = {}
    splits, telling = {}, {}
    for x, target in targets.items():
        split = split_labels(target)
        if isinstance(split, float):
            heads[x] = split
        else:
            splits[x], telling[x] = split, Telling()
    numbers = []
    for a, b, data, offsets in blocks(texts):
        owner, own, table = text_features(data, offsets)
        owner, own = _distinct(owner, own)
        numbers.append(pd.DataFrame(table))
        for x, counts in telling.items():
            used = np.zeros(b - a, dtype=bool)
            mine = splits[x][0]
            used[mine[(mine >= a) & (mine < b)] - a] = True
            counts.add(owner, own, np.nan_to_num(targets[x][a:b]), used)
    table = pd.concat(numbers, ignore_index=True)
    table["n_chars"] = np.log1p(sample.n_chars.fillna(0).clip(lower=0).to_numpy(dtype=float))
    edges = {k: np.quantile(table[k], CUTS) for k in sorted({*TEXT_NUMBERS, *PAGE_NUMBERS})}
    bins = {k: np.searchsorted(e, table[k], "right") for k, e in edges.items()}

    # read once more, for the few buckets that are used
    chosen = {x: counts.chosen() for x, counts in telling.items()}
    used = np.zeros(BUCKETS, dtype=bool)
    for own in chosen.values():
        used[own] = True
    rows, buckets = [], []
    for a, _, data, offsets in blocks(texts):
        owner, own, _ = text_features(data, offsets)
        owner, own = _distinct(owner[used[own]], own[used[own]])
        rows.append(owner + a)
        buckets.append(own)
    rows, buckets, names = np.concatenate(rows), np.concatenate(buckets), metadata(sample)
    for x, (fitted, held) in splits.items():
        heads[x] = fit_head(targets[x], fitted, held, chosen[x], rows, buckets, bins, names)
    return Model(edges, heads)


def fitting_rows(docs: DataFrame, labels: DataFrame, wanted: list[str]) -> DataFrame:
    """At most ``LABELLED`` documents with labels and ``UNLABELLED`` others, by hashes of ids.

    Of a repeated doc_id the text of least hash counts, texts over ``SAMPLE_BYTES`` never do.
    """
    labels = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    labels = labels.agg(*[F.max(F.col(x).cast("double")).alias(x) for x in wanted])
    order = F.xxhash64("doc_id")
    known = labels.orderBy(order, "doc_id").limit(LABELLED)
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    others = ids.orderBy(order, "doc_id").limit(UNLABELLED).distinct()
    others = others.join(labels, "doc_id", "left_anti")
    others = others.select("doc_id", *[F.lit(None).cast("double").alias(x) for x in wanted])
    # both are bounded by the limits above
    picked = F.broadcast(known.unionByName(others))
    rows = docs.where(F.octet_length("text") <= SAMPLE_BYTES).join(picked, "doc_id")
    columns = rows.columns
    own = F.struct(F.xxhash64("text").alias("text_key"), *[x for x in columns if x != "doc_id"])
    rows = rows.groupBy("doc_id").agg(F.min(own).alias("one"))
    return rows.select("doc_id", *[f"one.{x}" for x in columns if x != "doc_id"])


def _ordered(rows: pa.Table) -> pd.DataFrame:
    return rows.to_pandas().sort_values(["doc_id", "text"]).reset_index(drop=True)


def fitting_sample(docs: DataFrame, labels: DataFrame, wanted: list[str]) -> pd.DataFrame:
    """The rows of ``fitting_rows`` in the order that a model is fitted on."""
    return _ordered(fitting_rows(docs, labels, wanted).toArrow())


def quality_scores(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Documents with p_quality, p_toxic, score and keep added.

    Two views of a document are classified apart: its words, and its metadata (language,
    source, size, layout). They are co-trained on a bounded sample of documents, by hashes
    of their ids; every whole document is then scored by both views, each calibrated on
    held-out labels, in one combination. score is p_quality * (1 - p_toxic); keep holds if
    a document is more likely good than not, and more likely not toxic than toxic.

    Null text counts as empty, null language and source as values of their own, null n_chars
    as 0. Without labels both probabilities are 0.5 and everything is kept; a label of which
    only one class is known has that probability. Documents with several labels count as the
    greatest. Repeated rows and null doc_ids come back as they are, other columns as well;
    columns of the added names are replaced. No documents give no rows. Memory: the sample
    in one task, of which the driver gets the model; a block of 1 MiB of text, or one longer
    text, in the others.
    """
    added = ["p_quality", "p_toxic", "score", "keep"]
    docs = docs.drop(*added)
    if model is None:
        view = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", "n_chars")
        wanted = ["quality", "toxic"]
        sample = fitting_rows(view, labels, wanted)
        model = Model.of(*in_one_task(lambda rows: fit(_ordered(rows), wanted).plain(), sample))
        free_memory(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index("text")

    def run(batch):
        for first, end, data, offsets in blocks(batch.column(at)):
            part = batch.slice(first, end - first)
            meta = {x: part.column(docs_columns.index(x)) for x in ("lang", "source", "n_chars")}
            found = model.score(data, offsets, pa.table(meta).to_pandas())
            good, toxic = found["quality"], found["toxic"]
            keep = (good >= ACCEPT) & (toxic <= ACCEPT)
            columns = [good, toxic, good * (1 - toxic), keep]
            yield pa.record_batch(
                [*part.columns, *[pa.array(x) for x in columns]], [*batch.schema.names, *added]
            )

    docs_columns = docs.columns
    schema = f"{fields}, p_quality double, p_toxic double, score double, keep boolean"
    return by_text(run, docs, schema)
