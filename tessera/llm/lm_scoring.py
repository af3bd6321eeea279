"""LM scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token from `reach` tokens on each
side. Tokens are words; the vocabulary is the corpus's own, counted over all
documents. A word's probability is factored without overlap:

    p(word) = p(class | context) p(id | class) p(cell | bucket)

The network gives the first factor. The second is the id's share of its class in
the corpus. The third is 1 for the `vocabulary` most frequent words; other words
share `buckets` ids, and each bucket is divided into cells of a hash whose shares
are counted too (a cell holds more than one word only where hashes meet). So the
network starts as the unigram model and training can only add context.

1. Words are counted over all documents.
2. Every text is tokenised once, into ids that are staged; on the way each id's
   neighbours are summed up in a random projection.
3. Classes are cut from these sums: the ids are split again and again along the
   direction of largest spread, into parts of equal share of the corpus.
4. Each round, tasks train on their documents from the shared weights (numpy,
   Adagrad), and the results are averaged: embeddings by how often a task met
   the word, all else by its tokens. A round takes the share `train_share` of the
   documents by hash, and the rounds' shares follow on each other, so that every
   position of every document is trained on.
5. A document's score is the sum of its tokens' conditional log-probabilities.

Scale: word counts are partial aggregates and shuffle with the corpus; network,
cells and projections have a fixed size, and so has what is broadcast or sent to
the driver.

Defined cases: null and empty texts have no tokens, score 0 and a null mean; equal
rows score equally; very long texts are cut into lanes like any other; extra
columns are ignored; an empty table trains nothing and scores nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support as S

#: Counts that stand for a word never seen: of an id in its class, of a cell in its bucket.
UNSEEN_ID, UNSEEN_CELL = 0.5, 0.1
#: Tokens whose training or scoring is done at once.
TRAIN_TOKENS, SCORE_TOKENS = 1 << 17, 1 << 13
#: Groups in which the tasks' vectors are summed before the driver adds them up.
SUM_GROUPS = 16


@dataclass(frozen=True)
class Settings:
    reach: int = 3
    vocabulary: int = 8192  # the most frequent words; others share `buckets` ids
    buckets: int = 1024  # a power of two
    cell_bits: int = 21
    hidden: int = 16
    classes: int = 48
    sketch: int = 8
    rounds: int = 2
    train_share: float = 0.5  # of all documents in a round; the rounds together take each once
    rate: float = 0.2
    lanes: int = 8  # places of the text that a batch mixes
    run: int = 256  # neighbouring positions of a lane in a batch
    seed: int = 7

    def __post_init__(self) -> None:
        if self.ids > 1 << 15:
            raise ValueError("ids are kept in 16 bits: vocabulary and buckets must have fewer than 32,768 ids together")

    @property
    def ids(self) -> int:
        return 1 + self.vocabulary + self.buckets  # id 0 pads


def _merged(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(np.concatenate(words), return_inverse=True)
    return found, np.bincount(back, np.concatenate(counts), len(found)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count) over all documents; words are 64-bit hashes, counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            found, totals = _merged(words, counts)
            for i in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(S.signed(found[i : i + (1 << 16)])), pa.array(totals[i : i + (1 << 16)])], names=["word", "count"])

        words, counts, held = [], [], 0
        for _, buf, at in S.slices(batches, "text", 1 << 20):
            low = S.lower_ascii(buf)
            starts, ends, _ = S.word_bounds(low, at)
            own, n = np.unique(S.span_hashes(low, starts, ends), return_counts=True)
            words.append(own)
            counts.append(n)
            held += len(own)
            if held > 1 << 20:
                yield from rows()
                words, counts, held = [], [], 0
        if held:
            yield from rows()

    return docs.select("text").mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


class Coder:
    """Ids of words, the counts of ids, and the shares of cells in their buckets."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, cells: np.ndarray, settings: Settings):
        self.settings, self.order = settings, np.argsort(words)
        self.words = words[self.order]
        by_bucket = cells.reshape(-1, settings.buckets)  # a word's bucket is its lowest bits
        self.counts = np.zeros(settings.ids)
        self.counts[1 : 1 + len(counts)] = counts
        self.counts[1 + settings.vocabulary :] = by_bucket.sum(0)
        total = self.counts[1 + settings.vocabulary :] + UNSEEN_CELL * len(by_bucket)
        self.cell_log = np.log((by_bucket + np.float32(UNSEEN_CELL)) / total.astype(np.float32)).ravel()

    def code(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the log-probability of each word's cell in its bucket (0 for the words of the vocabulary)."""
        s = self.settings
        ids = 1 + s.vocabulary + (hashes & np.uint64(s.buckets - 1)).astype(np.int64)
        rare = np.ones(len(hashes), bool)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            ids[known] = 1 + self.order[at[known]]
            rare = ~known
        logs = np.zeros(len(hashes))
        logs[rare] = self.cell_log[(hashes[rare] & np.uint64((1 << s.cell_bits) - 1)).astype(np.int64)]
        return ids, logs


def vocabulary(counts: DataFrame, settings: Settings) -> Coder:
    """The most frequent words, and the counts of all others by cell: at most 2**cell_bits rows."""
    top = counts.orderBy(F.desc("count"), "word").limit(settings.vocabulary).collect()
    cells = np.zeros(1 << settings.cell_bits, np.float32)
    if len(top) == settings.vocabulary:
        last = top[-1]
        others = counts.where((F.col("count") < last["count"]) | ((F.col("count") == last["count"]) & (F.col("word") > last["word"])))
        found = others.groupBy(F.col("word").bitwiseAND((1 << settings.cell_bits) - 1).alias("cell")).agg(F.sum("count").alias("count")).toArrow()
        cells[np.array(found["cell"])] = np.array(found["count"])
    return Coder(np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["count"] for r in top], float), cells, settings)


def _padded(ids: np.ndarray, bounds: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' ids with `reach` zeros before, between and after them, and the ids' places."""
    n = len(bounds) - 1
    places = np.arange(len(ids)) + reach * (np.repeat(np.arange(n), np.diff(bounds)) + 1)
    out = np.zeros(len(ids) + reach * (n + 1), np.int16)
    out[places] = ids
    return out, places


def _projection(settings: Settings) -> np.ndarray:
    out = np.random.default_rng(settings.seed).choice(np.array([-1, 1], np.float32), (settings.ids, settings.sketch))
    out[0] = 0
    return out


def coded(docs: DataFrame, coder: Coder) -> DataFrame:
    """doc_id, row, ids, rare_log of every row, and a row with only `sketch` for every task: sums of each id's neighbours."""
    settings, kind = coder.settings, docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    names = ["doc_id", "row", "ids", "rare_log", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, reach = shared.value, settings.reach
        signs, sums, of_id = _projection(settings), np.zeros((settings.sketch, settings.ids)), None
        for part, buf, at in S.slices(batches, "text"):
            of_id = part.schema.field("doc_id").type
            low = S.lower_ascii(buf)
            starts, ends, bounds = S.word_bounds(low, at)
            ids, logs = coder.code(S.span_hashes(low, starts, ends))
            line, places = _padded(ids, bounds, reach)
            run_up = np.concatenate([np.zeros((1, settings.sketch), np.float32), np.cumsum(signs[line], 0, dtype=np.float32)])
            near = run_up[places + reach + 1] - run_up[places - reach] - signs[ids]
            for k in range(settings.sketch):
                sums[k] += np.bincount(ids, near[:, k], settings.ids)
            total = np.concatenate([[0.0], np.cumsum(logs)])
            data = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(ids.astype("<i2"))])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), data, pa.array(total[bounds[1:]] - total[bounds[:-1]]), pa.nulls(len(part), pa.binary())], names=names)
        if of_id is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, of_id), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64()), pa.array([sums.astype(np.float32).tobytes()])], names=names)

    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    out = S.staged(texts.mapInArrow(run, f"doc_id {kind}, row long, ids binary, rare_log double, sketch binary"), "coded")
    S.release(shared)
    return out


def summed(vectors: DataFrame) -> np.ndarray | None:
    """The sum of a column of equally long float32 vectors: partial sums in a few groups, then theirs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                own = np.frombuffer(data, np.float32)
                total = own.astype(np.float64) if total is None else np.add(total, own, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()])], names=["v"])

    add.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = vectors.toDF("v").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SUM_GROUPS))).groupBy("part")
    rows = [np.frombuffer(r["v"], np.float32).astype(np.float64) for r in parts.applyInArrow(add, "v binary").collect()]
    return sum(rows) if rows else None


def id_classes(sketch: np.ndarray, counts: np.ndarray, classes: int) -> np.ndarray:
    """A class for every id but the padding: parts of about equal share of the corpus, cut across the direction of largest spread."""
    known = np.maximum(counts, 1e-9)
    rows = sketch / known[:, None]
    rows -= (rows * counts[:, None]).sum(0) / max(counts.sum(), 1)
    rows *= np.sqrt(counts / (counts + 20))[:, None]  # what was met seldom says little
    weights, out, open_parts, named = counts + UNSEEN_ID, np.zeros(len(counts), np.int64), [(np.arange(1, len(counts)), classes)], 0
    while open_parts:
        own, wanted = open_parts.pop()
        if wanted < 2 or len(own) < 2:
            out[own] = named
            named += 1
            continue
        w = weights[own]
        spread = rows[own] - (rows[own] * w[:, None]).sum(0) / w.sum()
        direction = np.linalg.eigh((spread * w[:, None]).T @ spread)[1][:, -1]
        own = own[np.argsort(spread @ direction, kind="stable")]
        mass = np.cumsum(weights[own])
        left = wanted // 2
        cut = int(np.clip(np.searchsorted(mass, mass[-1] * left / wanted) + 1, 1, len(own) - 1))
        open_parts += [(own[cut:], wanted - left), (own[:cut], left)]
    return out


class Network:
    """An embedding per id, a weight per side, distance and unit, one tanh layer and a soft-max over classes.

    Arrays of positions are held units first, so that numpy works along the text.
    """

    def __init__(self, settings: Settings, class_log: np.ndarray):
        s, rng = settings, np.random.default_rng(settings.seed)
        self.settings, k = s, len(class_log)
        self.e = rng.normal(0, 0.1, (s.ids, s.hidden)).astype(np.float32)
        self.e[0] = 0
        self.dense = {"side": np.full((2 * s.reach, s.hidden), 0.5, np.float32), "bias": np.zeros(s.hidden, np.float32), "out": rng.normal(0, 0.1, (k, s.hidden)).astype(np.float32), "out_bias": class_log.astype(np.float32)}
        self.offsets = [d for d in range(-s.reach, s.reach + 1) if d]

    def start_training(self) -> None:
        self.squares = {k: np.full(v.shape, 1e-3, np.float32) for k, v in self.dense.items()}
        self.e_squares, self.met, self.tokens = np.full(len(self.e), 1e-3, np.float32), np.zeros(len(self.e), np.float32), 0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """From embeddings (units, lanes, positions with their margins)."""
        n, side = x.shape[2] - 2 * self.settings.reach, self.dense["side"]
        h = np.empty((*x.shape[:2], n), np.float32)
        h[:] = self.dense["bias"][:, None, None]
        part = np.empty_like(h)
        for k, d in enumerate(self.offsets):
            np.multiply(x[:, :, self.settings.reach + d : self.settings.reach + d + n], side[k][:, None, None], out=part)
            h += part
        return np.tanh(h, out=h)

    def logits(self, h: np.ndarray) -> np.ndarray:
        out = self.dense["out"] @ h.reshape(len(h), -1)
        out += self.dense["out_bias"][:, None]
        return out  # of a tanh layer of this size: far from overflow

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        """(units, lanes, positions)."""
        return np.ascontiguousarray(self.e[ids.ravel()].T).reshape(-1, *ids.shape)

    def class_logs(self, line: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The log-probability of the class of each id of a padded line, without its margins."""
        reach, out = self.settings.reach, np.zeros(len(line), np.float64)
        for i in range(0, len(line) - 2 * reach, SCORE_TOKENS):
            part = line[i : i + SCORE_TOKENS + 2 * reach].astype(np.int64)
            logits = self.logits(self.hidden(self.embedded(part[None])))
            n = logits.shape[1]
            own = logits[classes[part[reach : reach + n]], np.arange(n)]
            np.exp(logits, out=logits)
            out[i + reach : i + reach + n] = own - np.log(np.ones(len(logits), np.float32) @ logits)
        return out

    def train(self, line: np.ndarray, classes: np.ndarray) -> None:
        """One pass over a padded line, cut into lanes that are read side by side."""
        s = self.settings
        span = -(-(len(line) - 2 * s.reach) // s.lanes)
        if span <= 0:
            return
        line = np.concatenate([line, np.zeros(s.lanes * span + 2 * s.reach - len(line), line.dtype)])
        first = (np.arange(s.lanes) * span)[:, None]
        for j in range(0, span, s.run):
            self._step(line[first + np.arange(j, min(j + s.run, span) + 2 * s.reach)], classes)

    def _step(self, ids: np.ndarray, classes: np.ndarray) -> None:
        s, w, n = self.settings, self.dense, ids.shape[1] - 2 * self.settings.reach
        target = ids[:, s.reach : s.reach + n].ravel()
        at = np.flatnonzero(target)
        if not len(at):
            return
        x = self.embedded(ids)
        h = self.hidden(x)
        p = self.logits(h)
        np.exp(p, out=p)
        p *= (target > 0).astype(np.float32) / (np.ones(len(p), np.float32) @ p)
        p[classes[target[at]], at] -= 1
        flat, scale = h.reshape(len(h), -1), np.float32(1 / len(at))
        p *= scale
        steps = {"out": p @ flat.T, "out_bias": p.sum(1)}
        dh = w["out"].T @ p
        flat *= flat
        dh *= np.subtract(1, flat, out=flat)
        dh = dh.reshape(h.shape)
        dx, side, part = np.zeros_like(x), np.empty_like(w["side"]), np.empty_like(dh)
        for k, d in enumerate(self.offsets):
            window = slice(s.reach + d, s.reach + d + n)
            side[k] = np.multiply(dh, x[:, :, window], out=part).reshape(len(h), -1).sum(1)
            dx[:, :, window] += np.multiply(dh, w["side"][k][:, None, None], out=part)
        steps |= {"side": side, "bias": dh.reshape(len(h), -1).sum(1)}
        for k, step in steps.items():
            self.squares[k] += step * step
            w[k] -= np.float32(s.rate) * step / np.sqrt(self.squares[k])
        order = np.argsort(ids.ravel(), kind="stable")
        rows = ids.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        step = np.add.reduceat(np.ascontiguousarray(dx.reshape(len(h), -1).T)[order], first, axis=0)
        rows, times = rows[first], np.diff(np.append(first, len(rows)))
        if rows[0] == 0:  # the padding stays 0
            rows, times, step = rows[1:], times[1:], step[1:]
        self.e_squares[rows] += np.einsum("ij,ij->i", step, step) / s.hidden
        self.e[rows] -= np.float32(s.rate) * step / np.sqrt(self.e_squares[rows])[:, None]
        self.met[rows] += times
        self.tokens += len(at)

    def to_vector(self) -> np.ndarray:
        """What the tasks' results are added up as: weights times how much each was trained, and that."""
        return np.concatenate([(self.e * self.met[:, None]).ravel(), self.met, *(v.ravel() * np.float32(self.tokens) for v in self.dense.values()), [self.tokens]]).astype(np.float32)

    def take_average(self, vector: np.ndarray) -> None:
        n = self.e.size
        met = vector[n : n + len(self.e)]
        known = met > 0
        self.e[known] = vector[:n].reshape(self.e.shape)[known] / met[known, None]
        at = n + len(self.e)
        for v in self.dense.values():
            v[...] = vector[at : at + v.size].reshape(v.shape) / vector[-1]
            at += v.size


@dataclass
class Model:
    """Network, class of each id, and log-share of each id in its class."""

    network: Network
    classes: np.ndarray
    within: np.ndarray


def untrained(coder: Coder, sketch: np.ndarray | None) -> Model:
    """The unigram model: classes from the sketch, all shares from counts."""
    s = coder.settings
    rows = np.zeros((s.ids, s.sketch)) if sketch is None else sketch.reshape(s.sketch, s.ids).T
    classes = id_classes(rows, coder.counts, s.classes)
    weights = coder.counts + UNSEEN_ID
    weights[0] = 0
    shares = np.bincount(classes, weights)
    within = np.log(np.maximum(weights, 1e-9) / shares[classes])
    return Model(Network(s, np.log(shares / shares.sum())), classes, within)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Ids of the slices of a coded table, and the rows' bounds among them."""
    for part, buf, at in S.slices(batches, "ids", 2 * TRAIN_TOKENS):
        yield part, buf.view("<i2").astype(np.int64), at >> 1


def train(docs: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, Model]:
    """The coded documents and the trained model."""
    settings = settings or Settings()
    context = docs.sparkSession.sparkContext
    S.small_batches(docs.sparkSession)
    counts = S.staged(word_counts(docs), "word-counts")
    coder = vocabulary(counts, settings)
    S.discard(counts)
    table = coded(docs, coder)
    model = untrained(coder, summed(table.where("sketch IS NOT NULL").select("sketch")))
    rows = table.where("sketch IS NULL").select("row", "ids")
    for turn in range(settings.rounds):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            model = shared.value
            own, share = model.network, settings.train_share
            own.e, own.dense = own.e.copy(), {k: v.copy() for k, v in own.dense.items()}
            own.start_training()
            for part, ids, bounds in _lines(batches):
                # the arcs of a circle that the rounds take are `share` long and lie end to end
                key = (S.mix64(np.array(part.column(0)).view(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                taken = np.ceil((turn + 1) * share - key) > np.ceil(turn * share - key)
                sizes = np.diff(bounds)
                ids = ids[np.repeat(taken, sizes)]
                own.train(_padded(ids, np.concatenate([[0], np.cumsum(sizes[taken])]), settings.reach)[0], model.classes)
            if own.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([own.to_vector().tobytes()])], names=["v"])

        total = summed(rows.mapInArrow(run, "v binary"))
        S.release(shared)
        if total is not None:
            model.network.take_average(total)
    return table, model


def score(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum) and mean_log_likelihood per row of a coded table."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, ids, bounds in _lines(batches):
            line, places = _padded(ids, bounds, model.network.settings.reach)
            logs = model.network.class_logs(line, model.classes)[places] + model.within[ids]
            sums, n = np.concatenate([[0.0], np.cumsum(logs)]), np.diff(bounds)
            total = sums[bounds[1:]] - sums[bounds[:-1]] + np.array(part.column(2))
            mean = np.where(n > 0, total / np.maximum(n, 1), np.nan)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(total), pa.array(mean, from_pandas=True)], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    rows = table.where("sketch IS NULL").select("doc_id", "ids", "rare_log")
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, log_likelihood double, mean_log_likelihood double")


def lm_score(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    return score(*train(docs, settings))
