"""Toxicity by a convolutional text classifier.

Words are hashed into buckets and have embeddings; filters of several widths slide over
the whole text, the maximum of each over all places goes through a rectifier, and a
logistic layer gives the score. The network is trained here, in numpy.

Learning takes every labelled document that may be learned from, whole. Their words are hashed
once and lie in parts (``PART_ROWS``, at most ``MOST_PARTS``) in the order of a hash of the id. In each
epoch every part trains the network of the epoch before on its own documents, ``BATCH`` at a time
or ``BATCH_WORDS`` words, by Adam that begins anew; what the parts changed is averaged, each row
of the embeddings over the parts that changed it. Changes are summed as whole numbers, so the
order of tasks changes nothing. A task holds one batch and the network, whatever its part holds.

A fifth of the documents, by another hash of the id, takes no part in training: it tells when to stop, scales
the scores to probabilities under the class shares of all labels that may be learned from, and gives
each language the threshold of its verdict under the class shares of all its labelled
documents; with fewer than ``LEAST_HELD`` documents of a class in it, all labelled documents do
that. The scale comes from counts of their logits, rounded to 1 / ``LOGIT_STEPS``. Scores see
the text alone.

``learning_sample`` and ``trained`` learn from a bounded sample on the driver instead
(``TRAIN_ROWS`` documents of each class, ``TRAIN_WORDS`` words), for trials; no query uses them.
``TRAIN_WORDS`` of 0 turns all learning off.

Only buckets that ``LEAST_DOCUMENTS`` training documents have get an embedding; all others
share one of zero. Null and empty texts are one such word. Documents without an id are
scored, and count as not held out. Without labels of both classes all scores are zero; if
there are labels of both, but no documents of both to learn from, a warning says so.
Labels other than 0 and 1 are left out; several labels of an id count one by one. Columns
added replace those of the same name.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.llm.common import (
    arrow_schema,
    ascii_crc32,
    checkpointed,
    importable,
    replaced,
    slices,
    staged,
    table,
    with_columns,
)
from platewise.llm.words import ALNUM, Words

TRAIN_ROWS = 3000
TRAIN_WORDS = 4_000_000
LEAST_DOCUMENTS = 4
BUCKET_BITS = 20
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
EPOCHS = 12
BATCH = 64
THRESHOLD = 0.7
LEAST_HELD = 20
LEAST_TOXIC = 20
PART_ROWS = 12_000
MOST_PARTS = 64
BATCH_WORDS = 1 << 18
LOGIT_STEPS = 1024
#: Thresholds that a language may have.
GRID = [float(t) for t in np.round(np.arange(0.5, 0.91, 0.05), 2)]
#: Fixed point of summed changes, and of summed losses.
CHANGE_UNIT, LOSS_UNIT = float(1 << 32), float(1 << 20)


def bucket_lists(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and the first word of each text."""
    words = Words.of(texts, ALNUM)
    if not len(words):
        return np.zeros(0, np.int32), words.first
    return (words.hashes() >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), words.first


@dataclass
class Network:
    row_of: np.ndarray  #: embedding of each bucket; 0 is that of all others
    embeddings: np.ndarray
    filters: list[np.ndarray]  #: by width: (filters, width, dimensions)
    biases: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    _tables: list[np.ndarray] | None = None

    @classmethod
    def start(cls, row_of: np.ndarray, odds: np.ndarray, seed: int = 7) -> Network:
        """``odds``: how much more often toxic documents have the words of a row. The
        first dimension begins with it, and the first filter of each width reads it."""
        rng = np.random.default_rng(seed)
        embeddings = rng.normal(0, 0.1, (len(odds), DIMENSIONS)).astype(np.float32)
        embeddings[:, 0] = odds
        embeddings[0] = 0
        filters = [rng.normal(0, 0.3, (FILTERS, w, DIMENSIONS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[0, :, :] *= 0.1
            f[0, :, 0] = 1
        n = FILTERS * len(WIDTHS)
        weights = np.full(n, 0.1, np.float32)
        return cls(row_of, embeddings, filters, np.zeros(n, np.float32), weights, -1.0)

    def fixed(self) -> Network:
        """Products of all embeddings and filters in place of both, for scoring."""
        self._tables = [
            np.ascontiguousarray(np.einsum("rd,fwd->wrf", self.embeddings, f)) for f in self.filters
        ]
        return self

    def rows(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words of each text, at least one, and then width - 1 of zero."""
        counts = np.diff(first)
        sizes = np.maximum(counts, 1) + max(WIDTHS) - 1
        begins = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        place = np.arange(len(buckets)) + np.repeat(begins - first[:-1], counts)
        out[place] = self.row_of[buckets]
        return out, begins

    def pooled(self, rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maximum of each filter over each text, and the responses at all places."""
        pads = max(WIDTHS) - 1
        ends = np.append(begins[1:], len(rows))
        beyond = (ends[:, None] - 1 - np.arange(pads)).ravel()
        maxima, responses = [], []
        tables = self._tables or self.fixed()._tables
        for tables_of_width in tables:
            z = tables_of_width[0][rows]
            for j in range(1, len(tables_of_width)):
                z[: len(rows) - j] += tables_of_width[j][rows[j:]]
            z[beyond] = -np.inf
            maxima.append(np.maximum.reduceat(z, begins, axis=0))
            responses.append(z)
        return np.concatenate(maxima, axis=1) + self.biases, responses

    def logits(self, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
        pooled, _ = self.pooled(rows, begins)
        return np.maximum(pooled, 0) @ self.weights + self.bias

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return sigmoid(a * self.logits(*self.rows(buckets, first)).astype(np.float64) + b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Sample:
    """Learning documents: buckets in one array, and for each its first place, label,
    language, and whether it is kept for calibration."""

    buckets: np.ndarray
    first: np.ndarray
    toxic: np.ndarray
    lang: list[str | None]
    held: np.ndarray

    def some(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.buckets[self.first[i] : self.first[i + 1]] for i in index]
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return np.concatenate([*parts, np.zeros(0, np.int32)]), first


def trained(
    sample: Sample, shares: tuple[float, float], by_lang: dict[str, tuple[float, float]], seed: int = 7
) -> Network | None:
    """``shares``: documents of class 0 and 1 among all that may be learned from;
    ``by_lang``: those of each language that can get a threshold."""
    learn, held = np.flatnonzero(~sample.held), np.flatnonzero(sample.held)
    if len(set(sample.toxic[learn])) < 2:
        return None
    buckets, first = sample.some(learn)
    document = np.repeat(np.arange(len(learn)), np.diff(first))
    pairs = np.unique(document.astype(np.int64) << BUCKET_BITS | buckets)
    has, label = pairs & ((1 << BUCKET_BITS) - 1), sample.toxic[learn][pairs >> BUCKET_BITS]
    toxic = np.bincount(has[label == 1], minlength=1 << BUCKET_BITS)
    clean = np.bincount(has[label == 0], minlength=1 << BUCKET_BITS)
    frequent = np.flatnonzero(toxic + clean >= LEAST_DOCUMENTS)
    row_of = np.zeros(1 << BUCKET_BITS, np.int32)
    row_of[frequent] = np.arange(1, len(frequent) + 1)
    n_toxic = int((sample.toxic[learn] == 1).sum())
    odds = np.log((toxic[frequent] + 0.5) / (n_toxic + 1))
    odds -= np.log((clean[frequent] + 0.5) / (len(learn) - n_toxic + 1))
    net = Network.start(row_of, np.append(0, np.clip(odds, -3, 4)), seed)
    judge = held if np.bincount(sample.toxic[held], minlength=2).min() >= LEAST_HELD else np.append(learn, held)
    _fit(net, sample, learn, judge, seed)
    logits = net.logits(*net.rows(*sample.some(judge))).astype(np.float64)
    net.scale = _scale(logits, sample.toxic[judge], shares)
    net.thresholds = _thresholds(
        sigmoid(net.scale[0] * logits + net.scale[1]), sample.toxic[judge], [sample.lang[i] for i in judge], by_lang
    )
    return net


def _fit(net: Network, sample: Sample, learn: np.ndarray, judge: np.ndarray, seed: int) -> None:
    """Adam on the cross entropy with balanced classes; the best epoch on ``judge`` stays."""
    rng = np.random.default_rng(seed)
    values = [net.embeddings, *net.filters, net.biases, net.weights, np.array([net.bias])]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    weight = {c: 0.5 / max(1e-9, float((sample.toxic[learn] == c).mean())) for c in (0, 1)}
    check = net.rows(*sample.some(judge))
    best, step = (np.inf, None), 0
    for epoch in range(EPOCHS + 1):
        if epoch:
            order = rng.permutation(learn)
            for k in range(0, len(order), BATCH):
                step += 1
                index = order[k : k + BATCH]
                gradients = _gradients(net, sample, index, weight)
                for v, g, (m, s) in zip(values, gradients, moments, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
                net.embeddings[0] = 0
                net.bias = float(values[-1][0])
                net._tables = None
        y = sample.toxic[judge]
        p = np.clip(sigmoid(net.logits(*check)), 1e-6, 1 - 1e-6)
        loss = -np.mean(np.where(y == 1, weight[1] * np.log(p), weight[0] * np.log(1 - p)))
        if loss < best[0]:
            best = loss, [v.copy() for v in values]
    for v, kept in zip(values, best[1], strict=True):
        v[...] = kept
    net.bias = float(values[-1][0])
    net._tables = None


def _gradients(net: Network, sample: Sample, index: np.ndarray, weight: dict) -> list[np.ndarray]:
    """Of embeddings, filters by width, biases, weights and bias. Only the places of the
    maxima have any."""
    rows, begins = net.rows(*sample.some(index))
    z, responses = net.pooled(rows, begins)
    h = np.maximum(z, 0)
    y = sample.toxic[index]
    by_class = np.where(y == 1, weight[1], weight[0])
    dlogit = ((sigmoid(h @ net.weights + net.bias) - y) * by_class / len(index)).astype(np.float32)
    dz = dlogit[:, None] * net.weights * (z > 0)
    ends = np.append(begins[1:], len(rows))
    embeddings = np.zeros_like(net.embeddings)
    out = []
    for k, (f, response) in enumerate(zip(net.filters, responses, strict=True)):
        own = dz[:, k * FILTERS : (k + 1) * FILTERS]
        top = np.stack([a + response[a:b].argmax(axis=0) for a, b in zip(begins, ends, strict=True)])
        at = rows[top[:, :, None] + np.arange(f.shape[1])]
        out.append(np.einsum("bf,bfwd->fwd", own, net.embeddings[at]))
        np.add.at(embeddings, at, own[:, :, None, None] * f[None])
    return [embeddings, *out, dz.sum(axis=0), dlogit @ h, np.array([dlogit.sum()])]


def _weights(toxic: np.ndarray, shares: tuple[float, float], n: np.ndarray | None = None) -> np.ndarray:
    """For each document, or each ``n`` of them, a weight that gives the classes their shares."""
    n = np.ones(len(toxic)) if n is None else n
    of_class = np.array([n[toxic == c].sum() for c in (0, 1)])
    return (np.array(shares) / sum(shares) * n.sum() / np.maximum(of_class, 1))[toxic] * n


def _scale(
    logits: np.ndarray, toxic: np.ndarray, shares: tuple[float, float], n: np.ndarray | None = None
) -> tuple[float, float]:
    """Logistic regression of the label on the logit, by Newton steps, with the classes
    weighted as in all labels and a little pull towards no change; then moved so that
    ``THRESHOLD`` is where the weighted F1 is best. ``n`` counts documents of equal logit and label."""
    w = _weights(toxic, shares, n)
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    t = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ t)
        gradient = x.T @ (w * (p - toxic)) + np.array([0.1 * (t[0] - 1), 0.01 * t[1]])
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.01])
        t = t - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    slope = float(max(t[0], 0.3))
    order = np.argsort(-logits, kind="stable")
    hits, called = np.cumsum((w * toxic)[order]), np.cumsum(w[order])
    f1 = 2 * hits / (called + hits[-1])
    f1[:-1][logits[order][:-1] == logits[order][1:]] = -1  # a cut never parts equals
    last = int(f1.argmax())
    below = logits[order][min(last + 1, len(order) - 1)]
    cut = float((logits[order][last] + below) / 2)
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


def _thresholds(
    scores: np.ndarray, toxic: np.ndarray, lang: list[str | None], by_lang: dict[str, tuple[float, float]]
) -> dict[str, float]:
    """For each language with ``LEAST_TOXIC`` toxic documents, the threshold from 0.5 to 0.9
    of the best F1, with the classes weighted as in all labelled documents of the language;
    the one nearest to ``THRESHOLD`` of equals."""
    out = {}
    names = np.array(["" if x is None else x for x in lang])
    for name in sorted(set(names) - {""}):
        s, y = scores[names == name], toxic[names == name]
        if y.sum() < LEAST_TOXIC:
            continue
        over = [tuple(int(((y == c) & (s >= t)).sum()) for c in (0, 1)) for t in GRID]
        out[name] = _threshold((int((y == 0).sum()), int(y.sum())), over, by_lang[name])
    return out


def _threshold(n: tuple[int, int], over: list[tuple[int, int]], shares: tuple[float, float]) -> float:
    """From the documents of each class and those at or above each threshold of ``GRID``."""
    w = [shares[c] / sum(shares) * sum(n) / max(n[c], 1) for c in (0, 1)]
    # Rounded, so that sums of weights in another order do not part equals.
    f1 = [round(2 * w[1] * b / (w[0] * a + w[1] * (b + n[1])), 12) for a, b in over]
    return min(zip(GRID, f1, strict=True), key=lambda x: (-x[1], abs(x[0] - THRESHOLD)))[0]


def _usable(labels: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The labels that may be learned from, and how many there are of each class."""
    usable = labels.filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int"))
    usable = usable.filter(ascii_crc32(F.col("doc_id")) % 3 != 1)
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    return usable, (counts.get(0, 0), counts.get(1, 0))


def learning_sample(
    docs: DataFrame, labels: DataFrame
) -> tuple[Sample, tuple[float, float], dict[str, tuple[float, float]]]:
    """The bounded sample, the number of all labels of each class, and for each language that
    can get a threshold the number of its labelled documents of each class. Ids and labels
    are chosen first, so that only the texts of the sample are read on."""
    usable, shares = _usable(labels)
    # Each task gives its first rows of a class, so that no task orders all labels of one.
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    clean, toxic = (usable.filter(F.col("toxic") == c).orderBy(*by_hash).limit(TRAIN_ROWS) for c in (0, 1))
    of_class = Window.partitionBy("toxic").orderBy(*by_hash)
    chosen = clean.union(toxic).withColumn("n", F.row_number().over(of_class))
    # At most TRAIN_ROWS rows of two classes, so that no text is shuffled.
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    schema = "doc_id long, toxic int, n int, lang string, buckets binary"
    fields = pa.schema(
        [("doc_id", pa.int64()), ("toxic", pa.int32()), ("n", pa.int32()), ("lang", pa.string()), ("buckets", pa.binary())]
    )
    rows = importable(texts).mapInArrow(partial(_hashed, schema=fields), schema)
    taken, words = [], 0
    for r in rows.orderBy("n", "toxic", "doc_id").toLocalIterator():
        size = len(r["buckets"]) // 4
        if words + size > TRAIN_WORDS:
            continue
        words += size
        taken.append(r)
    lists = [np.frombuffer(r["buckets"], np.int32) for r in taken]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    sample = Sample(
        np.concatenate([*lists, np.zeros(0, np.int32)]),
        first,
        np.array([r["toxic"] for r in taken], np.int64),
        [r["lang"] for r in taken],
        np.array([r["n"] % 5 == 0 for r in taken], bool),
    )
    return sample, shares, _by_lang(docs, usable, sample)


def _by_lang(docs: DataFrame, usable: DataFrame, sample: Sample) -> dict[str, tuple[float, float]]:
    toxic = Counter(x for x, y in zip(sample.lang, sample.toxic, strict=True) if y and x)
    # At most TRAIN_ROWS / LEAST_TOXIC languages.
    langs = [x for x, n in toxic.items() if n >= LEAST_TOXIC]
    if not langs:
        return {}
    labelled = docs.select("doc_id", "lang").filter(F.col("lang").isin(langs)).join(usable, "doc_id")
    counts = {(r["lang"], r["toxic"]): r["count"] for r in labelled.groupBy("lang", "toxic").count().collect()}
    return {x: (counts.get((x, 0), 0), counts.get((x, 1), 0)) for x in langs}


def _hashed(
    batches: Iterator[pa.RecordBatch], schema: pa.Schema, packed: bool = False
) -> Iterator[pa.RecordBatch]:
    """``packed``: three bytes a bucket in place of four."""
    for batch, texts in slices(batches, "text"):
        buckets, first = bucket_lists(texts)
        if packed:
            buckets = buckets.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]
        lists = [buckets[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
        yield replaced(batch, schema, buckets=pa.array(lists, pa.binary()))


def learning_rows(docs: DataFrame, usable: DataFrame, parts: int) -> DataFrame:
    """The labelled documents, one partition for each part, in the order of learning."""
    schema = "doc_id long, lang string, buckets binary"
    fields = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("buckets", pa.binary())])
    texts = docs.select("doc_id", "lang", "text").filter(ascii_crc32(F.col("doc_id")) % 3 != 1)
    # Buckets are shuffled, which are half of a text. Labels grow with the documents: no broadcast.
    hashed = importable(texts).mapInArrow(partial(_hashed, schema=fields, packed=True), schema)
    hashed = hashed.join(usable.hint("merge"), "doc_id")
    place = F.xxhash64("doc_id")
    # Another hash than that of the parts, so that each part has its fifth.
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 0
    dealt = hashed.withColumns({"place": place, "held": held}).repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int"))
    ordered = dealt.sortWithinPartitions("place", "doc_id", "toxic", "lang", "buckets")
    return checkpointed(ordered.select("toxic", "held", "lang", "buckets"))


def _unpacked(buckets) -> np.ndarray:
    """The buckets of three bytes each."""
    raw = np.frombuffer(buckets, np.uint8).reshape(-1, 3)
    out = np.zeros((len(raw), 4), np.uint8)
    out[:, :3] = raw
    return out.view("<i4").ravel().astype(np.int32, copy=False)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[Sample]:
    """The rows in order, ``BATCH`` learning documents or about ``BATCH_WORDS`` words at a time."""
    pending: list[tuple] = []
    learning = words = 0

    def sample() -> Sample:
        toxic, held, lang, lists = zip(*pending, strict=True)
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return Sample(np.concatenate(lists), first, np.array(toxic, np.int64), list(lang), np.array(held, bool))

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("toxic", "held", "lang"))
        for toxic, held, lang, buckets in zip(*columns, batch.column("buckets"), strict=True):
            one = _unpacked(buckets.as_buffer())
            if pending and (learning == BATCH or words + len(one) > BATCH_WORDS):
                yield sample()
                pending, learning, words = [], 0, 0
            pending.append((toxic, held, lang, one))
            learning += not held
            words += len(one)
    if pending:
        yield sample()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training documents of each class that have a bucket."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for sample in _samples(batches):
        for i in np.flatnonzero(~sample.held):
            counts[sample.toxic[i], np.unique(sample.buckets[sample.first[i] : sample.first[i + 1]])] += 1
    found = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_pydict({"bucket": found, "clean": counts[0][found], "toxic": counts[1][found]})


def _local(net: Network, sample: Sample, index: np.ndarray) -> tuple[Network, Sample, np.ndarray]:
    """The network with the embeddings of these documents alone, the documents on it, and
    the rows of those embeddings."""
    buckets, first = sample.some(index)
    used, at = np.unique(np.append(0, net.row_of[buckets]), return_inverse=True)
    rows = np.arange(len(used), dtype=np.int32)
    local = Network(rows, net.embeddings[used], net.filters, net.biases, net.weights, net.bias)
    lang = [sample.lang[i] for i in index]
    return local, Sample(at[1:].astype(np.int32), first, sample.toxic[index], lang, sample.held[index]), used


def _local_logits(net: Network, sample: Sample, index: np.ndarray) -> np.ndarray:
    local, some, _ = _local(net, sample, index)
    return local.logits(*local.rows(some.buckets, some.first)).astype(np.float64)


def _judges(sample: Sample, all_judge: bool) -> np.ndarray:
    return np.arange(len(sample.toxic)) if all_judge else np.flatnonzero(sample.held)


class _Part:
    """Adam on the documents of one part, on a copy of the network. Rows of embeddings
    that a batch does not move keep their moments."""

    def __init__(self, net: Network) -> None:
        parts = [f.copy() for f in net.filters], net.biases.copy(), net.weights.copy()
        self.net = Network(net.row_of, net.embeddings.copy(), *parts, net.bias)
        self.values = [self.net.embeddings, *self.net.filters, self.net.biases, self.net.weights, np.array([net.bias])]
        self.moments = [(np.zeros_like(v), np.zeros_like(v)) for v in self.values]
        self.steps = 0

    def step(self, sample: Sample, index: np.ndarray, weight: dict) -> None:
        local, some, used = _local(self.net, sample, index)
        gradients = _gradients(local, some, np.arange(len(index)), weight)
        moved = np.flatnonzero(gradients[0].any(axis=1) & (used > 0))
        places = [used[moved], *[slice(None)] * (len(self.values) - 1)]
        gradients[0] = gradients[0][moved]
        self.steps += 1
        for v, g, (m, s), at in zip(self.values, gradients, self.moments, places, strict=True):
            m[at] += 0.1 * (g - m[at])
            s[at] += 0.01 * (g * g - s[at])
            v[at] -= 0.01 * (m[at] / (1 - 0.9**self.steps)) / (np.sqrt(s[at] / (1 - 0.99**self.steps)) + 1e-6)
        self.net.bias = float(self.values[-1][0])


def _flat(net: Network) -> np.ndarray:
    """Everything but the embeddings, in rows as wide as theirs."""
    values = np.concatenate([*[f.ravel() for f in net.filters], net.biases, net.weights, [net.bias]]).astype(np.float64)
    return np.append(values, np.zeros(-len(values) % DIMENSIONS)).reshape(-1, DIMENSIONS)


def _moved(net: Network, keys: np.ndarray, changes: np.ndarray) -> Network:
    """The network with changes of rows; rows behind the embeddings are those of ``_flat``."""
    n = len(net.embeddings)
    embeddings, flat = net.embeddings.copy(), _flat(net)
    own = keys < n
    embeddings[keys[own]] += changes[own].astype(np.float32)
    flat[keys[~own] - n] += changes[~own]
    values = flat.ravel()
    sizes = [*[f.size for f in net.filters], net.biases.size, net.weights.size, 1]
    *filters, biases, weights, bias = np.split(values[: sum(sizes)], np.cumsum(sizes)[:-1])
    filters = [x.reshape(f.shape).astype(np.float32) for x, f in zip(filters, net.filters, strict=True)]
    return Network(net.row_of, embeddings, filters, biases.astype(np.float32), weights.astype(np.float32), float(bias[0]))


_CHANGES = [f"v{i}" for i in range(DIMENSIONS)]


def _epoch(
    batches: Iterator[pa.RecordBatch], model, weight: dict, all_judge: bool, learn: bool
) -> Iterator[pa.RecordBatch]:
    """The loss of the network on the judging documents of a part, under the key -1, and
    what training on the others changes."""
    net: Network = model.value
    part, loss = _Part(net), 0.0
    for sample in _samples(batches):
        judges, learning = _judges(sample, all_judge), np.flatnonzero(~sample.held)
        if len(judges):
            y = sample.toxic[judges]
            p = np.clip(sigmoid(_local_logits(net, sample, judges)), 1e-6, 1 - 1e-6)
            loss -= float(np.where(y == 1, weight[1] * np.log(p), weight[0] * np.log(1 - p)).sum())
        if learn and len(learning):
            part.step(sample, learning, weight)
    keys, changes = np.array([-1]), np.zeros((1, DIMENSIONS))
    changes[0, 0] = loss * LOSS_UNIT
    if part.steps:
        rows = np.flatnonzero((part.net.embeddings != net.embeddings).any(axis=1))
        flat = _flat(part.net) - _flat(net)
        keys = np.concatenate([keys, rows, len(net.embeddings) + np.arange(len(flat))])
        moved = part.net.embeddings[rows].astype(np.float64) - net.embeddings[rows]
        changes = np.concatenate([changes, moved * CHANGE_UNIT, flat * CHANGE_UNIT])
    whole = np.rint(changes).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"key": keys} | {c: whole[:, i] for i, c in enumerate(_CHANGES)})


def _judged(batches: Iterator[pa.RecordBatch], model, all_judge: bool) -> Iterator[pa.RecordBatch]:
    net: Network = model.value
    for sample in _samples(batches):
        index = _judges(sample, all_judge)
        logits = _local_logits(net, sample, index) if len(index) else np.zeros(0)
        lang = pa.array([sample.lang[i] for i in index], pa.string())
        toxic = pa.array(sample.toxic[index], pa.int32())
        yield pa.RecordBatch.from_pydict({"lang": lang, "toxic": toxic, "logit": logits})


def learned(docs: DataFrame, labels: DataFrame) -> tuple[Network | None, tuple[int, int]]:
    """The network trained on all labelled documents, and the labels of each class; None
    without documents of both classes to learn from."""
    usable, shares = _usable(labels)
    if min(shares) == 0 or not TRAIN_WORDS:
        return None, shares
    parts = min(MOST_PARTS, -(-sum(shares) // PART_ROWS))
    rows = learning_rows(docs, usable, parts)
    counts = Counter({(r["held"], r["toxic"]): r["count"] for r in rows.groupBy("held", "toxic").count().collect()})
    n_clean, n_toxic = counts[False, 0], counts[False, 1]
    if min(n_clean, n_toxic) == 0:
        return None, shares
    all_judge = min(counts[True, 0], counts[True, 1]) < LEAST_HELD
    net = _begun(rows, n_clean, n_toxic)
    weight = {0: 0.5 * (n_clean + n_toxic) / n_clean, 1: 0.5 * (n_clean + n_toxic) / n_toxic}
    net = _trained_in_parts(rows, net, weight, all_judge)
    model = docs.sparkSession.sparkContext.broadcast(net)
    judged = rows.mapInArrow(partial(_judged, model=model, all_judge=all_judge), "lang string, toxic int, logit double")
    judged = staged(judged, "toxicity-judged")
    # A bounded number of logits: 2 * 64 * LOGIT_STEPS + 1.
    step = F.round(F.greatest(F.lit(-64.0), F.least(F.lit(64.0), "logit")) * LOGIT_STEPS).cast("long").alias("step")
    seen = judged.groupBy(step, "toxic").count().orderBy("step", "toxic").toArrow()
    logits, toxic, n = (seen.column(c).to_numpy() for c in ("step", "toxic", "count"))
    net.scale = _scale(logits / LOGIT_STEPS, toxic, shares, n.astype(np.float64))
    net.thresholds = _language_thresholds(rows, judged, net.scale)
    return net, shares


def _begun(rows: DataFrame, n_clean: int, n_toxic: int) -> Network:
    """The network before training, with the buckets and odds of all training documents."""
    found = rows.mapInArrow(_document_counts, "bucket long, clean long, toxic long")
    found = found.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # At most one row for each bucket.
    found = found.filter(F.col("clean") + F.col("toxic") >= LEAST_DOCUMENTS).orderBy("bucket").toArrow()
    bucket, clean, toxic = (found.column(c).to_numpy() for c in ("bucket", "clean", "toxic"))
    row_of = np.zeros(1 << BUCKET_BITS, np.int32)
    row_of[bucket] = np.arange(1, len(bucket) + 1)
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return Network.start(row_of, np.append(0, np.clip(odds, -3, 4)))


def _trained_in_parts(rows: DataFrame, net: Network, weight: dict, all_judge: bool) -> Network:
    """The network of the epoch that is best on the judging documents."""
    means = [(F.sum(c) / F.count(F.lit(1)) / CHANGE_UNIT).cast("float").alias(c) for c in _CHANGES]
    schema = ", ".join(["key long", *[f"{c} long" for c in _CHANGES]])
    best = np.inf, net
    for epoch in range(EPOCHS + 1):
        model = rows.sparkSession.sparkContext.broadcast(net)
        task = partial(_epoch, model=model, weight=weight, all_judge=all_judge, learn=epoch < EPOCHS)
        # At most one row for each bucket, and 37.
        changed = rows.mapInArrow(task, schema).groupBy("key").agg(F.sum("v0").alias("loss"), *means).toArrow()
        model.unpersist()
        keys = changed.column("key").to_numpy()
        loss = int(changed.column("loss").to_numpy()[keys == -1][0])
        if loss < best[0]:
            best = loss, net
        moves = np.stack([changed.column(c).to_numpy() for c in _CHANGES], axis=1)
        net = _moved(net, keys[keys >= 0], moves[keys >= 0])
    return best[1]


def _language_thresholds(rows: DataFrame, judged: DataFrame, scale: tuple[float, float]) -> dict[str, float]:
    """``_thresholds`` from counts, one row for each language with ``LEAST_TOXIC`` toxic judging documents."""
    of = [F.col("toxic") == c for c in (0, 1)]
    cuts = [(float(np.log(t / (1 - t))) - scale[1]) / scale[0] for t in GRID]
    over = F.array(*[F.array(*[F.count_if(x & (F.col("logit") >= cut)) for x in of]) for cut in cuts])
    named = F.col("lang") != ""
    judging = judged.filter(named).groupBy("lang").agg(*[F.count_if(x).alias(f"n{c}") for c, x in enumerate(of)], over.alias("over"))
    every = rows.filter(named).groupBy("lang").agg(*[F.count_if(x).alias(f"all{c}") for c, x in enumerate(of)])
    found = judging.filter(F.col("n1") >= LEAST_TOXIC).join(every, "lang").collect()
    return {
        r["lang"]: _threshold((r["n0"], r["n1"]), [tuple(x) for x in r["over"]], (r["all0"], r["all1"])) for r in found
    }


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents with ``score`` and ``threshold``, that of their language."""
    net, shares = learned(docs, labels)
    if net is None and min(shares) > 0:
        message = f"no network: {shares[0]} clean and {shares[1]} toxic labels, but no documents of both to learn from"
        warnings.warn(f"{message}; all toxicity scores are 0", RuntimeWarning, stacklevel=2)
    if net is not None:
        net.fixed()
        net.embeddings, net.filters = net.embeddings[:0], []
    # Its size is bounded by the parameters: an index of all buckets, and at most a row for each.
    model = docs.sparkSession.sparkContext.broadcast(net)
    schema = with_columns(docs, ("score", "double"), ("threshold", "double"))
    score = partial(_score, model=model, schema=arrow_schema(schema))
    return importable(docs).mapInArrow(score, schema)


def _score(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    net: Network | None = model.value
    limits = net.thresholds if net is not None else {}
    for batch, texts in slices(batches, "text"):
        scores = np.zeros(len(texts)) if net is None else net.scores(*bucket_lists(texts))
        langs = batch.column("lang").to_pylist()
        yield replaced(
            batch, schema, score=scores, threshold=[limits.get(x, THRESHOLD) for x in langs]
        )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        F.coalesce(ascii_crc32(F.col("doc_id")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "threshold",
    )
