"""Quality classifier with hierarchical empirical Bayes.

1. Two logistic models are fitted on a bounded sample of labelled documents (SAMPLE rows and SAMPLE_BYTES of text at most, the first by hash of the id): quality
   from the shape of a text, toxicity from a lexicon of words and word beginnings that the sample's toxic documents have.
   The lexicon comes from one half of the sample and the weights of what it finds from the other.
2. Every document gets both probabilities in one pass, without a shuffle; they are written with its other columns.
3. Probabilities are summed by path (source, language), then by host (source), then over all, with map-side aggregation, so a hot host
   is a handful of partial sums. Each level's rate is shrunk toward its parent's with as many pseudo-documents as the variance between
   siblings supports (method of moments): sparse sites lean on the host, sparse hosts on the corpus.
4. A document's log odds are moved by the difference of its path's and the corpus's log odds, held within SITE_LIMIT,
   so that a site can tip a doubtful document and never overrules a clear one.

Null and empty texts are rated as texts without words. Null sources or languages are a site of their own. Without labels the prior is
one half and nothing is rejected. Of labelled documents with equal texts the first by hash of the id counts, so the models don't depend on how the
rows are dealt. All columns of the input come back, with __quality, __toxicity and __keep (an underscore more where the input has such
a column). The tables have no paths beside sources, so in the queries the host is the source and the path its language.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace, let_go, release, slices, unused

#: Labelled rows that the models see and bytes of their texts, pseudo-documents' bounds, the farthest that a site moves a document's log odds.
SAMPLE_BYTES = 128 << 20
SAMPLE, FEWEST, MOST, SITE_LIMIT = 6000, 4.0, 10_000.0, 1.0
SUPPORT, PREFIXES = 4, (4, 5, 6)
CACHE_WORDS, CACHE_CHARS = 100_000, 64
_WORDS = re.compile(r"[^\W\d_]+")
_KINDS = np.zeros((256, 5))
for _column, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@[\\]^_`{}~", b"!", b"|")):
    _KINDS[list(_bytes), _column] = 1


def shape(text: str) -> list[float]:
    """Numbers that describe a text whatever its language; all are between 0 and about 1."""
    raw = text.encode()
    kinds = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _KINDS / max(len(raw), 1)
    words = text.split()
    m = max(len(words), 1)
    lines = text.split("\n")
    letters = max(sum(w.isalpha() for w in words), 1)
    ends = sum(w[-1] in ".!?" for w in words)
    return [
        *kinds,
        sum(w.isupper() for w in words) / m,
        len(set(words)) / m,
        1 - len(set(lines)) / len(lines),
        min(1.0, sum(map(len, words)) / m / 20),
        ends / m,
        letters / (letters + m),
        math.log1p(len(words)) / 10,
    ]


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k)]


def _words(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


def lexicon(texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Log odds of words and beginnings that toxic texts have much more often. Other texts are counted for what enough toxic ones have, so memory is bounded by these."""
    bad: Counter = Counter()
    for text, t in zip(texts, toxic):
        if t:
            bad.update({f for w in _words(text) for f in _features(w)})
    bad = Counter({f: n for f, n in bad.items() if n >= SUPPORT})
    good: Counter = Counter()
    for text, t in zip(texts, toxic):
        if not t:
            good.update({f for w in _words(text) for f in _features(w) if f in bad})
    n_bad, n_good = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    out = {}
    for f in bad:
        weight = math.log((bad[f] + 0.5) / (n_bad + 1)) - math.log((good[f] + 0.5) / (n_good + 1))
        if bad[f] >= 4 * good[f] and weight > 2:
            out[f] = weight
    return out


def lexical(text: str, weights: dict[str, float], known: dict[str, float]) -> list[float]:
    """Strongest word, sum over the words (both scaled), share of words that the lexicon has."""
    found = []
    words = _words(text)
    for w in words:
        got = known.get(w)
        if got is None:
            if len(known) >= CACHE_WORDS:
                known.clear()
            got = max((weights.get(f, 0.0) for f in _features(w)), default=0.0)
            if len(w) <= CACHE_CHARS:
                known[w] = got
        if got:
            found.append(got)
    return [max(found, default=0.0) / 5, math.log1p(sum(found)), min(1.0, 20 * len(found) / max(len(words), 1))]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised columns: (mean, scale, weights with the intercept last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(min(steps, 40)):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def predict(model, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    mean, scale, w = model
    z = np.clip((x - mean) / scale, -8, 8) @ w[:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], quality: np.ndarray, toxic: np.ndarray) -> dict:
    """Both models; None where the sample has one class only."""
    shapes = np.array([shape(t) for t in texts]).reshape(len(texts), -1)
    out: dict = {"quality": None, "toxic": None, "lexicon": {}}
    if 0 < quality.sum() < len(quality):
        out["quality"] = fit(shapes, quality)
    if 0 < toxic.sum() < len(toxic):
        half = np.arange(len(texts)) % 2 == 0
        pick = lambda mask: [t for t, m in zip(texts, mask) if m]
        x, y = [], []
        for one in (half, ~half):
            part = lexicon(pick(one), toxic[one])
            known: dict[str, float] = {}
            x += [lexical(t, part, known) for t in pick(~one)]
            y += list(toxic[~one])
        out["toxic"] = fit(np.array(x), np.array(y))
        out["lexicon"] = lexicon(texts, toxic)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(text, quality, toxic) of at most `sample` labelled documents and SAMPLE_BYTES of text, the first by hash of the id and in that order; equal texts count once."""
    order = F.xxhash64("id")
    few = labels.where("quality is not null and toxic is not null").select(F.col("doc_id").alias("id"), "quality", "toxic").orderBy(order, "id", "quality", "toxic").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(few), "id")
    first = rows.groupBy("text").agg(F.min(F.struct(order.alias("h"), "id", "quality", "toxic")).alias("first"))
    # Texts are fetched up to a bound of bytes, told from their sizes alone.
    held, last = 0, None
    for key, size in first.select("first", F.octet_length("text")).orderBy("first").limit(sample).toLocalIterator():
        held += size
        if held > SAMPLE_BYTES:
            break
        last = key
    if last is None:
        first = first.limit(0)
    else:
        h, i, q, t = last
        first = first.where(F.col("first") <= F.struct(F.lit(h).alias("h"), F.lit(i).alias("id"), F.lit(q).alias("quality"), F.lit(t).alias("toxic")))
    return first.orderBy("first").limit(sample).select("text", F.col("first.quality").cast("double").alias("quality"), F.col("first.toxic").cast("double").alias("toxic"))


RATES = ("good", "bad")


def _shrunk(sites: DataFrame, keys: list[str]) -> DataFrame:
    """sites: keys, n, and for each rate its sum of probabilities and the parent's rate (_sum, _up). The posterior rates (_post) with the parent's:
    the parent's rate counts as many documents as the variance between the sites supports."""
    kappas = []
    for r in RATES:
        up = F.col(f"{r}_up")
        gap = F.col(f"{r}_sum") / F.col("n") - up
        spread = F.greatest(F.sum(F.col("n") * gap * gap) / F.sum("n") - F.sum(up * (1 - up)) / F.sum("n"), F.lit(1e-6))
        kappas.append(F.least(F.greatest(F.avg(up * (1 - up)) / spread, F.lit(FEWEST)), F.lit(MOST)).alias(f"{r}_kappa"))
    post = [((F.col(f"{r}_sum") + F.col(f"{r}_kappa") * F.col(f"{r}_up")) / (F.col("n") + F.col(f"{r}_kappa"))).alias(f"{r}_post") for r in RATES]
    return sites.crossJoin(F.broadcast(sites.agg(*kappas))).select(*keys, *post, *(f"{r}_up" for r in RATES))


def _log_odds(p):
    held = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(held / (1 - held))


def site_moves(paths: DataFrame, space: Workspace) -> DataFrame:
    """paths: (host, path, n, good_sum, bad_sum). How far each path moves the log odds of its documents (good_move, bad_move).

    Corpus, hosts and paths are three levels; each level's rates are shrunk toward the one above."""
    sums = [F.sum(c).alias(c) for c in ("n", *(f"{r}_sum" for r in RATES))]
    top = space.save(paths.agg(*((F.sum(f"{r}_sum") / F.sum("n")).alias(f"{r}_up") for r in RATES)), "corpus")
    hosts = space.save(_shrunk(space.save(paths.groupBy("host").agg(*sums).crossJoin(F.broadcast(top)), "hosts"), ["host"]), "host-rates")
    inner = paths.join(hosts.select("host", *(F.col(f"{r}_post").alias(f"{r}_up") for r in RATES)), "host")
    posts = _shrunk(space.save(inner, "paths-and-hosts"), ["host", "path"]).drop(*(f"{r}_up" for r in RATES))
    moves = [F.least(F.greatest(_log_odds(F.col(f"{r}_post")) - _log_odds(F.col(f"{r}_up")), F.lit(-SITE_LIMIT)), F.lit(SITE_LIMIT)).alias(f"{r}_move") for r in RATES]
    return posts.crossJoin(F.broadcast(top)).select("host", "path", *moves)


def rate_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE, keep_text: bool = True) -> DataFrame:
    """docs with __quality, __toxicity (posteriors) and __keep; without the text column if keep_text is false.

    Each text is rated once; the ratings are written beside the other columns, and the sites' shares come from that table.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "quality")
    got = labelled_sample(docs, labels, id_col, text_col, sample).toArrow()
    texts = got.column(0).to_pylist()
    model = train(texts, *(np.array(got.column(c).to_pylist()) for c in (1, 2))) if texts else {"quality": None, "toxic": None, "lexicon": {}}
    del got, texts
    release()
    let_go(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    good, bad, host, path = (unused(docs, n) for n in ("good", "bad", "host", "path"))

    def run(batches):
        models, known = shared.value, {}
        for batch in slices(batches, text_col):
            texts = [t.as_py() or "" for t in batch.column(text_col)]
            rates = predict(models["quality"], np.array([shape(t) for t in texts]))
            toxic = predict(models["toxic"], np.array([lexical(t, models["lexicon"], known) for t in texts])) if models["toxic"] else np.zeros(len(texts))
            names = [f.name for f in keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rates), pa.array(toxic)], names=[*names, good, bad])

    schema = T.StructType([*keep, T.StructField(good, T.DoubleType()), T.StructField(bad, T.DoubleType())])
    rated = space.save(docs.mapInArrow(run, schema), "rated")
    site = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0"))
    paths = rated.groupBy(site(host_col).alias("host"), site(path_col).alias("path")).agg(F.count("*").alias("n"), F.sum(good).alias("good_sum"), F.sum(bad).alias("bad_sum"))
    moves = space.save(site_moves(space.save(paths, "paths"), space), "moves").select(F.col("host").alias(host), F.col("path").alias(path), "good_move", "bad_move")
    moves = moves.withColumnsRenamed({f"{r}_move": unused(docs, f"{r}_move") for r in RATES})
    moved = [F.coalesce(F.col(unused(docs, f"{r}_move")), F.lit(0.0)) for r in RATES]
    out = rated.withColumns({host: site(host_col), path: site(path_col)}).join(moves, [host, path], "left")
    back = lambda x: 1 / (1 + F.exp(-x))
    quality = back(_log_odds(F.col(good)) + moved[0])
    toxicity = F.when(F.col(bad) > 0, back(_log_odds(F.col(bad)) + moved[1])).otherwise(F.lit(0.0))
    names = [unused(docs, n) for n in ("__quality", "__toxicity", "__keep")]
    return out.select(*[F.col(f"`{f.name}`") for f in keep], quality.alias(names[0]), toxicity.alias(names[1]), ((quality >= 0.5) & (toxicity < 0.5)).alias(names[2]))
