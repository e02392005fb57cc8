"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line has a few surface features; a line is judged by its own, the previous and the next line's features, and neighbouring
labels by four transition weights. Only documents are labelled, so in learning every line carries its document's label. The
weights maximize the conditional log-likelihood (exact gradients by forward-backward, Adam steps). A document's score is the mean
of its lines' marginals of being good, weighted by line length.

Learning takes about ``learn_rows`` labelled documents of each label (a documented bound); of one with more than ``learn_lines`` lines, so
many in ``STRETCHES`` stretches drawn by seeded hash from all of it, each a chain; scoring reads every line of every text in one pass without a shuffle.

Edges: null and empty texts are one line without words and get its score; one-line and very long texts go the same way; null or
repeated ids are scored like others; with several labels for one id each is learned from; without labelled rows of both labels the
score is the share of good labels (0.5 without any); an empty table gives no rows; labels, lang, source and ids are never inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.common import bounded_sample, held, learned, rows_where, table
from cardwatch.runtime import lookup_join

#: lines of a document learned from, by default, and the stretches they are drawn in; lines of a batch scored together
LINES, STRETCHES, BATCH_LINES = 1000, 10, 50_000
STEPS, RATE, RIDGE = 200, 0.05, 1e-4
GOOD = 0.7

UPPER, LOWER, DIGIT = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
SENTENCE, SYMBOL, SPACE = b".,;:?'\"()-", b"!#*$%&|<>@^~_=+{}[]\\/`", b" \t\n\r\x0b\x0c"
MARKS = (UPPER, LOWER, DIGIT, SENTENCE, SYMBOL, SPACE)
FEATURES = 19


def line_features(text: str):
    """(lines, FEATURES) of a text and its lines' lengths."""
    import math
    from collections import Counter

    import numpy as np

    lines = text.encode("utf-8", "replace").split(b"\n")
    often = Counter(lines)
    seen: set[bytes] = set()
    rows, sizes = [], []
    for line in lines:
        n = len(line)
        found = line.split()
        k, some = len(found), max(len(found), 1)
        shares = [(n - len(line.translate(None, m))) / max(n, 1) for m in MARKS]
        distinct = set(found)
        pairs = set(zip(found, found[1:], strict=False))
        rows.append((
            1.0, not found, math.log1p(n) / 8, math.log1p(k) / 6, *shares, 1 - sum(shares),
            (n - line.count(b" ")) / some / 10, len(distinct) / some, len(pairs) / max(k - 1, 1),
            sum(a == b for a, b in zip(found, found[1:], strict=False)) / some, len(distinct & seen) / max(len(distinct), 1),
            often[line] > 1, sum(w[-1:].isalpha() or w[-1] in SENTENCE or w[-1] > 127 for w in found) / some,
            line[-1:] in (b".", b"?", b"!"),
        ))
        seen |= distinct
        sizes.append(n)
    return np.array(rows, np.float32).reshape(-1, FEATURES), np.array(sizes, np.float64)


def with_neighbours(own, starts):
    """Features of a line, the line before and the line after; zeros beyond a document's ends."""
    import numpy as np

    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts[:-1]], after[starts[1:] - 1] = 0, 0
    return np.hstack([own, before, after])


class Chains:
    """Documents of one batch laid out by line number, so that forward-backward steps through all of them at once."""

    def __init__(self, starts):
        import numpy as np

        self.starts, sizes = starts, np.diff(starts)
        self.order = np.argsort(-sizes, kind="stable")
        self.first, longest = starts[:-1][self.order], int(sizes.max(initial=0))
        falling = -sizes[self.order]
        self.live = [int(np.searchsorted(falling, -t)) for t in range(longest)]  # documents with more than t lines

    def run(self, emission, transition):
        """Log-partition of every document, marginals (lines, 2) and expected transitions (2, 2)."""
        import numpy as np

        n = len(self.order)
        forward, scale = np.zeros_like(emission), np.zeros(len(emission))
        peak = emission.max(axis=1, keepdims=True) if len(emission) else emission
        local, move = np.exp(emission - peak), np.exp(transition)
        alpha = np.ones((n, 2))
        for t, k in enumerate(self.live):
            at = self.first[:k] + t
            alpha = (alpha[:k] @ move if t else alpha[:k]) * local[at]
            total = alpha.sum(axis=1)
            alpha /= total[:, None]
            forward[at], scale[at] = alpha, total
        marginal, pairs = forward.copy(), np.zeros((2, 2))
        beta = np.ones((0, 2))
        for t in range(len(self.live) - 1, 0, -1):
            k = self.live[t]
            at = self.first[:k] + t
            beta = np.vstack([beta, np.ones((k - len(beta), 2))])
            ahead = beta * local[at] / scale[at][:, None]
            pairs += move * (forward[at - 1].T @ ahead)
            beta = ahead @ move.T
            marginal[at - 1] = forward[at - 1] * beta
        logs = np.log(scale) + peak[:, 0] if len(emission) else scale
        return logs.sum(), marginal, pairs


def fit(features, starts, labels):
    """Weights (features, 2) and transitions (2, 2) by Adam on the mean conditional log-likelihood of the documents."""
    import numpy as np

    chains = Chains(starts)
    sizes = np.diff(starts)
    lines = np.repeat(labels, sizes)
    truth = np.zeros((len(lines), 2))
    truth[np.arange(len(lines)), lines] = 1
    stay = np.zeros((2, 2))
    for label in (0, 1):
        stay[label, label] = (sizes[labels == label] - 1).sum()
    w = [np.zeros((features.shape[1], 2)), np.zeros((2, 2))]
    m, v = [[np.zeros_like(x) for x in w] for _ in range(2)]
    for step in range(1, STEPS + 1):
        _, marginal, pairs = chains.run(features @ w[0], w[1])
        slopes = [features.T @ (truth - marginal) / len(sizes) - RIDGE * w[0], (stay - pairs) / len(sizes) - RIDGE * w[1]]
        for k in (0, 1):
            m[k] = 0.9 * m[k] + 0.1 * slopes[k]
            v[k] = 0.99 * v[k] + 0.01 * slopes[k] ** 2
            w[k] = w[k] + RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return w


def stretches(lines, drawn: list[int], bound: int):
    """All lines of a document as one chain, or, of more than ``bound``, seeded stretches from all of it, about so many lines together."""
    import numpy as np

    if len(lines) <= bound:
        return [lines]
    size = max(1, bound // STRETCHES)
    count = -(-len(lines) // size)
    chosen = np.random.default_rng(drawn).choice(count, min(count, bound // size), replace=False)
    return [lines[k * size:(k + 1) * size] for k in sorted(chosen.tolist())]


def learn(docs: DataFrame, labels: DataFrame, *, learn_rows: int, seed: int, learn_lines: int = LINES):
    """Fit on docs (doc_id, text) with labels (doc_id, quality). Ids are drawn first, so only texts of the sample move; the
    driver gets line features only, of a bounded number of documents and lines."""
    import numpy as np

    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    drawn = bounded_sample(known, "doc_id", learn_rows, seed, "quality")
    rows = lookup_join(docs.select("doc_id", "text"), drawn, "doc_id", "inner").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", "quality"
    )

    def describe(batches):
        import zlib

        import pandas as pd

        for batch in batches:
            found = [
                (doc, label, x.tobytes())
                for doc, label, text in zip(batch["doc_id"], batch["quality"], batch["text"], strict=True)
                for x in stretches(line_features(text or "")[0], [seed, zlib.crc32(doc.encode())], learn_lines)
            ]
            yield pd.DataFrame(found, columns=["doc_id", "quality", "lines"])

    sample = rows.mapInPandas(describe, "doc_id string, quality int, lines binary").toPandas()
    labels = sample["quality"].to_numpy()
    if len(set(labels)) < 2:
        return float(labels.mean()) if len(labels) else 0.5
    sample = sample.sort_values(["doc_id", "lines"])
    found = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in sample["lines"]]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    own = np.vstack(found)
    weights, transition = fit(with_neighbours(own, starts).astype(np.float64), starts, sample["quality"].to_numpy())
    return weights, transition


def scored(texts, model):
    """(number of lines, score) of texts, in runs of about ``BATCH_LINES`` lines."""
    import numpy as np

    def finish(part):
        starts = np.concatenate([[0], np.cumsum([len(x) for x, _ in part])])
        sizes = np.concatenate([s for _, s in part]) + 1  # a line counts with its line end
        if isinstance(model, float):
            good = np.full(len(sizes), model)
        else:
            inputs = with_neighbours(np.vstack([x for x, _ in part]), starts).astype(np.float64)
            good = Chains(starts).run(inputs @ model[0], model[1])[1][:, 1]
        score = np.add.reduceat(good * sizes, starts[:-1]) / np.add.reduceat(sizes, starts[:-1])
        return list(zip(np.diff(starts).tolist(), np.clip(score, 0, 1).tolist(), strict=True))

    out, part, waiting = [], [], 0
    for text in texts:
        part.append(line_features(text or ""))
        waiting += len(part[-1][1])
        if waiting >= BATCH_LINES:
            out += finish(part)
            part, waiting = [], 0
    return out + (finish(part) if part else [])


def quality(docs: DataFrame, model, *, key: str = "doc_id", text: str = "text", threshold: float = GOOD) -> DataFrame:
    """key, n_lines, score and predicted of every row."""
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))

    def score(batches):
        import pandas as pd

        for batch in batches:
            found = pd.DataFrame(scored(batch["text"], model), columns=["n_lines", "score"])
            yield found.assign(doc_id=batch["doc_id"].to_numpy())[["doc_id", "n_lines", "score"]]

    found = rows.mapInPandas(score, "doc_id string, n_lines long, score double")
    return found.select(
        F.col("doc_id").cast(kind).alias(key), "n_lines", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def good_ones(docs: DataFrame, model, *, text: str = "text", threshold: float = GOOD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted good."""
    return rows_where(docs, text, lambda texts: [s >= threshold for _, s in scored(texts, model)])


def allowed(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: of a known id whose crc32 modulo 4 is not 2."""
    return labels.where(learned(F.col("doc_id"), 4, 2))


def op6_quality(spark, sf_dir: str, learn_rows: int = 3000, learn_lines: int = LINES) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, allowed(table(spark, sf_dir, "labels")), learn_rows=learn_rows, seed=42, learn_lines=learn_lines)
    return quality(docs, model).select(
        "doc_id", held(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted", "n_lines"
    )
