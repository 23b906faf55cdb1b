"""Toxicity scores by non-negative positive-unlabelled learning on hashed word and prefix features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import discard, free_name, prepare, stage, split_words, string_hashes, text_column

BITS = 18
PREFIXES = (4, 5, 6)
#: Bounds of the training sample, in labelled documents; of the second number the labels are not looked at
MAX_POSITIVE, MAX_UNLABELLED = 3000, 6000
THRESHOLD = 0.7
#: Folds whose scores calibrate the weights
FOLDS = 4
EDGES = ".,;:!?\"'()[]{}<>*_-"


def held_out(doc_id=None):
    """True for rows that training must not see: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id or "doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _word_features(words: pa.StringArray) -> np.ndarray:
    """(words, 1 + prefixes) feature numbers: the word without punctuation at its edges, and its prefixes."""
    bare = pc.utf8_trim(words, characters=EDGES)
    length = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.int64)
    mask = np.uint64((1 << BITS) - 1)
    for k, size in enumerate((0, *PREFIXES)):
        h = string_hashes(pc.utf8_slice_codeunits(bare, 0, size) if size else bare) * np.uint64(2 * k + 1)
        number = 1 + ((h >> np.uint64(40 - BITS)) & mask).astype(np.int64)
        out[:, k] = np.where(length > (size if size else 0), number, 0)  # 0: no feature
    return out


def _encoded(batch: pa.RecordBatch) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    words, offsets = split_words(text_column(batch))
    coded = words.dictionary_encode() if len(words) else pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), pa.array([], pa.string()))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), offsets


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, codes, offsets = _encoded(batch)
        table = _word_features(words)
        rows = []
        for i in range(batch.num_rows):
            own = np.unique(table[np.unique(codes[offsets[i] : offsets[i + 1]])])
            rows.append(own[own > 0].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("fold"), pa.array(rows, pa.list_(pa.int32()))], ["positive", "fold", "features"])


def telling(counts: tuple[np.ndarray, np.ndarray], n_p: int, n_u: int, least: int = 3, z: float = 6.0) -> np.ndarray:
    """True for features that confirmed examples have more often than other text, by z standard errors.

    counts: how many of the n_p confirmed examples, and of the n_u other documents, have each feature.
    """
    if not n_p or not n_u:
        return np.zeros(len(counts[0]), bool)
    p1, p0 = counts[0] / n_p, counts[1] / n_u
    spread = np.sqrt(np.maximum((counts[0] + counts[1] + 1) / (n_p + n_u + 1), 1e-9) * (1 / n_p + 1 / n_u))
    return (p1 - p0 >= z * spread) & (counts[0] >= least) & (p1 >= 1.5 * p0)


def _counted(features: list[np.ndarray], positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    none, dims = np.zeros(0, np.int64), (1 << BITS) + 1
    of = lambda side: np.bincount(np.concatenate([none, *(f for f, p in zip(features, positive, strict=True) if p == side)]), minlength=dims)
    return of(True), of(False)


def pu_risk(score: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of logits and the step's gradient in them.

    The risk is prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]) with the logistic loss; where the
    bracket is negative, the step goes up its gradient instead of down the whole.
    """
    soft = lambda x: np.logaddexp(0, x)
    prob = 0.5 * (1 + np.tanh(0.5 * score))
    negative = soft(score[~is_p]).mean() - prior * soft(score[is_p]).mean()
    g = np.zeros(len(score))
    down_p, down_u = -prior * prob[is_p] / is_p.sum(), prob[~is_p] / (~is_p).sum()
    if negative >= 0:
        g[is_p] = -prior * (1 - prob[is_p]) / is_p.sum() + down_p
        g[~is_p] = down_u
    else:
        g[is_p], g[~is_p] = -down_p, -down_u
    return prior * soft(-score[is_p]).mean() + max(0.0, negative), g


def nnpu_fit(
    features: list[np.ndarray], positive: np.ndarray, prior: float, epochs: int = 30, batch: int = 600, alpha: float = 0.1,
    l1: float = 0.02, l2: float = 1e-3, seed: int = 7,
) -> np.ndarray:
    """Weights (0: bias) that minimise the non-negative positive-unlabelled logistic risk, by FTRL-proximal steps.

    Only features that telling() picks take part; the risk is that of pu_risk().
    """
    known = telling(_counted(features, positive), int(positive.sum()), int((~positive).sum()))
    known[0] = True
    numbers = np.cumsum(known) - 1
    features = [numbers[f[known[f]]] for f in features]
    dims = int(known.sum())
    lengths = np.array([len(f) for f in features], np.int64)
    flat = np.concatenate(features) if features else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    pos, unl = np.nonzero(positive)[0], np.nonzero(~positive)[0]
    rng = np.random.default_rng(seed)
    z, n, w = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    w[0] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    z[0] = -w[0] * (0.05 / alpha + l2)
    full = np.zeros((1 << BITS) + 1)
    if not len(pos) or not len(unl):
        full[0] = w[0]
        return full
    for _ in range(epochs):
        p_order, u_order = rng.permutation(pos), rng.permutation(unl)
        steps = max(1, len(unl) // batch)
        for p, u in zip(np.array_split(p_order, steps), np.array_split(u_order, steps), strict=True):
            if not len(p):
                p = rng.choice(pos, min(len(pos), 64), replace=False)
            rows = np.concatenate([p, u])
            take = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(lengths[rows])[:-1]]), lengths[rows]) + np.arange(lengths[rows].sum())
            own = np.repeat(np.arange(len(rows)), lengths[rows])
            score = w[0] + np.bincount(own, w[flat[take]], len(rows))
            _, g = pu_risk(score, np.arange(len(rows)) < len(p), prior)
            grad = np.bincount(flat[take], g[own], dims)
            grad[0] = g.sum()
            sigma = (np.sqrt(n + grad * grad) - np.sqrt(n)) / alpha
            z += grad - sigma * w
            n += grad * grad
            limit = np.full(dims, l1 * 1.0)
            limit[0] = 0
            w = np.where(np.abs(z) > limit, -(z - np.sign(z) * limit) / ((0.05 + np.sqrt(n)) / alpha + l2), 0)
            w[1:] = np.maximum(w[1:], 0)  # a feature is evidence for toxicity or none; long clean text never outweighs it
    full[known] = w
    return full


def _logits(features: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    return np.array([w[0] + w[f].sum() for f in features])


def nnpu_train(features: list[np.ndarray], positive: np.ndarray, prior: float, fold: np.ndarray) -> np.ndarray:
    """Weights fitted to the whole sample, rescaled by what other folds' weights say about each fold.

    The slope minimises the risk on the other folds' logits; the shift puts the score THRESHOLD where the isotonic
    posterior of those logits reaches it.  A document may be in the sample twice, as a confirmed example and as unlabelled
    text; both must be in one fold.
    """
    w = nnpu_fit(features, positive, prior)
    if min((side & (fold == k)).sum() for side in (positive, ~positive) for k in range(FOLDS)) < 2:
        return w
    logit = np.zeros(len(features))
    for k in range(FOLDS):
        rest, own = np.nonzero(fold != k)[0], np.nonzero(fold == k)[0]
        part = nnpu_fit([features[i] for i in rest], positive[rest], prior)
        logit[own] = _logits([features[i] for i in own], part)
    slope, shift = calibrated(logit, positive, prior)
    cut = crossing(logit, positive, prior, THRESHOLD)
    if cut is not None:
        shift = np.log(THRESHOLD / (1 - THRESHOLD)) + 1e-6 - slope * cut
    out = w * slope
    out[0] = w[0] * slope + shift
    return out


def calibrated(logit: np.ndarray, positive: np.ndarray, prior: float, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the logit that minimise the same prior-corrected risk, by damped Newton steps.

    With two parameters the risk cannot be driven negative by memorising examples, so the correction needs no clipping.
    """
    at = np.stack([logit, np.ones(len(logit))], 1)
    p, u, theta = at[positive].mean(0), at[~positive], np.array([1.0, 0.0])
    for _ in range(steps):
        prob = 0.5 * (1 + np.tanh(0.5 * (u @ theta)))
        g = (u * prob[:, None]).mean(0) - prior * p + 1e-3 * (theta - [1.0, 0.0])
        h = (u * (prob * (1 - prob))[:, None]).T @ u / len(u) + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        theta = theta - move * min(1.0, 1.0 / max(np.abs(move).max(), 1e-9))
    return max(float(theta[0]), 0.1), float(theta[1])


def crossing(logit: np.ndarray, positive: np.ndarray, prior: float, level: float) -> float | None:
    """The least logit from which the posterior reaches `level`; None where it never does.

    The posterior is prior * (density of confirmed examples) / (density of unlabelled text), made monotone by pooling
    neighbours that are out of order.
    """
    mass = np.where(positive, prior / max(positive.sum(), 1), 0.0), np.where(positive, 0.0, 1.0 / max((~positive).sum(), 1))
    blocks: list[list[float]] = []
    for i in np.lexsort((~positive, logit)):
        blocks.append([logit[i], mass[0][i], mass[1][i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, p, u = blocks.pop()
            blocks[-1][1] += p
            blocks[-1][2] += u
    return next((float(at) for at, p, u in blocks if p >= level * u), None)


def fit(
    docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED
) -> np.ndarray:
    """Weights learnt from confirmed toxic documents and unlabelled text.

    Only labelled rows that are not held_out() take part.  At most max_positive confirmed examples, and max_unlabelled
    labelled documents whose labels are not looked at (both by a hash of the id; both are parameters) are fitted; the
    class prior is the share of toxic rows among all labelled ones that take part, 0.1 where there is none.  Labels with
    a null id or value are left out, a null or empty text has no feature, and rows that repeat an id count each.

    Features of the sample are counted by Spark; only those that telling() picks reach the driver.
    """
    prepare(docs.sparkSession)
    known = labels.where(~held_out()).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    prior = min(max(share if share is not None else 0.1, 0.001), 0.9)
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    # a bounded number of rows each, so broadcasting them is safe
    positive = known.where("toxic = 1").orderBy(order, "doc_id").limit(max_positive).select("doc_id", F.lit(True).alias("positive"))
    unlabelled = known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_unlabelled).select("doc_id", F.lit(False).alias("positive"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(FOLDS)).cast("int").alias("fold")
    chosen = docs.select("doc_id", "text").join(F.broadcast(positive.union(unlabelled)), "doc_id").select("positive", fold, "text")
    rows, rows_at = stage(chosen.mapInArrow(_features, "positive boolean, fold int, features array<int>"), "toxicity-features")
    n_p, n_u = (rows.where("positive" if side else "not positive").count() for side in (True, False))
    counted = (
        rows.select("positive", F.explode("features").alias("feature")).groupBy("feature")
        .agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).toArrow()
    )
    counts = np.zeros((2, (1 << BITS) + 1))
    for k, side in enumerate("pu"):
        counts[k, counted.column("feature").to_numpy()] = counted.column(side).to_numpy()
    picked = F.lit(np.nonzero(telling((counts[0], counts[1]), n_p, n_u))[0].tolist() or [-1]).cast("array<int>")
    sample = rows.select("positive", "fold", F.array_sort(F.array_intersect("features", picked)).alias("features")).toArrow()
    discard(docs.sparkSession, rows_at)
    flags, fold = np.array(sample.column("positive").to_pylist(), bool), sample.column("fold").to_numpy()
    lists = [np.array(x, np.int64) for x in sample.column("features").to_pylist()]
    # rows arrive in no fixed order; fit them in one that depends on their content only
    order = sorted(range(len(flags)), key=lambda i: (not flags[i], len(lists[i]), lists[i].tolist(), fold[i]))
    return nnpu_train([lists[i] for i in order], flags[order], prior, fold[order])


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, codes, offsets = _encoded(batch)
        table = _word_features(words)
        live = (weights[table] * (table > 0)).any(axis=1) if len(words) else np.zeros(0, bool)
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        keep = live[codes] if len(codes) else np.zeros(0, bool)
        total = np.full(batch.num_rows, float(weights[0]))
        if keep.any():
            features = table[codes[keep]]
            pairs = np.stack([np.repeat(row[keep], features.shape[1]), features.ravel()], 1)
            pairs = np.unique(pairs[(pairs[:, 1] > 0) & (weights[pairs[:, 1]] != 0)], axis=0)
            total = total + np.bincount(pairs[:, 0], weights[pairs[:, 1]], batch.num_rows)
        score = 0.5 * (1 + np.tanh(0.5 * total))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (1 from `threshold`).

    A null or empty text gets the score of the bias alone.  Null ids and repeated rows pass through; extra columns are
    ignored; an empty table gives an empty result.  Only the text enters the score.
    """
    prepare(docs.sparkSession)
    weights = weights.astype(np.float32)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _score(it, weights), "doc_id long, score double"
    )
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents scored below the threshold, with all their columns, whatever their names; texts are not shuffled.

    Null and empty texts get the score of the bias alone; null ids and repeated rows are scored each; an empty table
    gives an empty result.
    """
    weights = fit(docs, labels).astype(np.float32)
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def of(text):  # noqa: ANN001, ANN202
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), pa.array(text, pa.string())], ["doc_id", "text"])
        return next(_score(iter([batch]), weights)).column("score").to_pandas()

    name = free_name(docs, "score")
    return docs.withColumn(name, of("text")).where(F.col(name) < threshold).drop(name)
