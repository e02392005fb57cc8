"""Language ID by error-correcting output codes over hashed character n-grams.

Every language gets a codeword; a binary classifier per bit tells the languages with that bit from the others by the log ratio of
their n-gram frequencies. A text's bit value is its mean log ratio, scaled and shifted by a one-dimensional logistic fit.
Decoding is loss-weighted: the language whose codeword costs the least logistic loss over all bits, each bit weighted by its
accuracy, wins; the score is its share of exp(-cost). A text is ambiguous if the runner-up costs nearly as little.

Learning takes about ``learn_rows`` labelled rows of each language (a documented bound); counting and scaling run on the executors
and the driver sees one row per (language, bucket). Scoring is one pass without a shuffle over whole texts.

Edges: null text and texts without a letter are ``und`` with score 0; texts of any length are read whole, in parts that overlap;
null or repeated ids are scored like others, null ids are not learned from; without any labelled row all is ``und``; with one
language all is that language; an empty table gives no rows; label and id columns are never inputs of a prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.common import bounded_sample, held, learned, rows_where, table

DIMENSIONS = 1 << 16
ORDERS = (2, 3, 4)
UNKNOWN = "und"
#: bytes of text whose n-grams are looked up at once
PART = 1_000_000
#: n-grams a short text is short of: its mean log ratio shrinks by n / (n + SHRINK)
SHRINK = 20.0
#: cost difference under which the runner-up is too near
AMBIGUOUS = 0.5
#: most words a code may have, and bits by random codes
LANGUAGES, RANDOM_BITS = 1000, 31


def codewords(languages: int, seed: int):
    """Codewords (languages, bits) of +1 and -1: all splits of up to five languages, else the widest of random codes."""
    import numpy as np

    if languages <= 5:
        splits = range(1, 1 << (languages - 1)) if languages > 1 else range(0)
        return np.array([[1 if (s >> k) & 1 else -1 for s in splits] for k in range(languages)]).reshape(languages, -1)
    bits = max(RANDOM_BITS, 10 * (languages - 1).bit_length())
    random, best, widest = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = random.choice([-1, 1], (languages, bits))
        if (abs(code.sum(axis=0)) == languages).any():
            continue
        apart = (bits - code @ code.T) // 2 + bits * np.eye(languages, dtype=int)
        if apart.min() > widest:
            best, widest = code, apart.min()
    return best if best is not None else random.choice([-1, 1], (languages, bits))


def letters_only(text: str | None) -> bytes:
    """Lower-cased words of letters, parted and enclosed by one space; empty if there is no letter."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(NOT_LETTERS).split()) + b" "


#: ASCII other than letters becomes a space; bytes of longer characters stay
NOT_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def grams(data: bytes):
    """Bucket of every n-gram of a byte string, in overlapping parts."""
    import numpy as np

    tail = max(ORDERS) - 1
    for at in range(0, len(data), PART):
        text = np.frombuffer(data, np.uint8, min(PART + tail, len(data) - at), at).astype(np.uint32)
        found = []
        for n in ORDERS:
            ends = min(PART, max(len(text) - n + 1, 0))
            code = np.full(ends, n, np.uint32)
            for k in range(n):
                code = (code ^ text[k:k + ends]) * np.uint32(0x01000193)
                code ^= code >> np.uint32(15)
            found.append((code * np.uint32(0x9E3779B1)) >> np.uint32(16))
        yield np.concatenate(found)


def count_grams(batches):
    """mapInPandas function: n-grams of a task's labelled texts as (lang, bucket, n)."""
    import numpy as np
    import pandas as pd

    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            own = total.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
            for codes in grams(letters_only(text)):
                own += np.bincount(codes, minlength=DIMENSIONS)
    for lang, own in total.items():
        seen = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": seen, "n": own[seen]})


def bit_values(batch, weights):
    """Mean log ratio of each bit and number of n-grams, for the texts of a batch."""
    import numpy as np

    values, sizes = np.zeros((len(batch), weights.shape[1])), np.zeros(len(batch))
    for k, text in enumerate(batch):
        for codes in grams(letters_only(text)):
            sizes[k] += len(codes)
            values[k] += np.bincount(codes, minlength=DIMENSIONS) @ weights if len(codes) > DIMENSIONS else weights[codes].sum(axis=0)
    return values / (sizes[:, None] + SHRINK), sizes


class Model:
    """Languages, their codewords, weights (buckets, bits) and per bit scale, shift and trust."""

    def __init__(self, languages, code, weights):
        import numpy as np

        self.languages, self.code, self.weights = languages, code, weights
        bits = code.shape[1]
        self.scale, self.shift, self.trust = np.ones(bits), np.zeros(bits), np.ones(bits)

    def calibrate(self, values, languages) -> None:
        """Fit scale and shift of every bit by Newton steps with a small ridge; trust is the bit's accuracy over chance."""
        import numpy as np

        truth = self.code[[self.languages.index(x) for x in languages]] > 0
        for b in range(self.code.shape[1]):
            x = np.column_stack([values[:, b], np.ones(len(values))])
            w = np.array([1.0, 0.0])
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                slope = x.T @ (truth[:, b] - p) - 1e-2 * w
                curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
                w += np.clip(np.linalg.solve(curve, slope), -5, 5)
            self.scale[b], self.shift[b] = w
            right = ((x @ w > 0) == truth[:, b]).mean() if len(x) else 1.0
            self.trust[b] = max(2 * right - 1, 0.05)

    def decode(self, values):
        """Cost of every language for every text."""
        import numpy as np

        margin = values * self.scale + self.shift
        weight = self.trust / self.trust.sum()
        signed = margin[:, None, :] * self.code[None]
        return (np.logaddexp(0, -signed) * weight).sum(axis=2) * len(weight) ** 0.5


def learn(docs: DataFrame, *, learn_rows: int, seed: int) -> Model | None:
    """Fit on docs (doc_id, text, lang): counts and scaling run on the executors."""
    import numpy as np

    rows = bounded_sample(docs.where(F.col("lang").isNotNull()), "doc_id", learn_rows, seed, "lang").select("lang", "text")
    counted = rows.mapInPandas(count_grams, "lang string, bucket int, n long")
    counts = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if not languages:
        return None
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    share = np.zeros((len(languages), DIMENSIONS))
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        share[k, own["bucket"]] = own["n"]
    share = (share + 0.5) / (share + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(languages), seed)
    weights = np.zeros((DIMENSIONS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        weights[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    model = Model(languages, code, weights)
    if len(languages) > 1:
        def value(batches):
            import pandas as pd

            for batch in batches:
                values, sizes = bit_values(batch["text"], weights)
                yield pd.DataFrame({"lang": batch["lang"], "at": list(values), "n": sizes.astype("int64")})

        known = rows.mapInPandas(value, "lang string, at array<double>, n long").where("n > 0").toPandas()
        known = known.assign(order=known["at"].map(tuple)).sort_values(["lang", "order"])
        model.calibrate(np.array(known["at"].tolist()).reshape(len(known), -1), known["lang"].tolist())
    return model


def decided(texts, model: Model | None):
    """Arrays of label, score and whether the runner-up is near, of texts."""
    import numpy as np

    label, score, unsure = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool)
    if model is not None and len(texts):
        values, sizes = bit_values(texts, model.weights)
        some = np.flatnonzero(sizes > 0)
        cost = model.decode(values[some])
        order = np.sort(cost, axis=1)
        label[some] = np.array(model.languages, object)[cost.argmin(axis=1)]
        score[some] = 1 / np.exp(order[:, :1] - order).sum(axis=1)
        unsure[some] = (order[:, 1] - order[:, 0] < AMBIGUOUS) if cost.shape[1] > 1 else False
    return label, score, unsure


def languages(docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score and ambiguous of every row."""
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))

    def predict(batches):
        import pandas as pd

        for batch in batches:
            label, score, unsure = decided(batch["text"].tolist(), model)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": label, "score": score, "ambiguous": unsure})

    found = rows.mapInPandas(predict, "doc_id string, lang_pred string, score double, ambiguous boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", key)


def known_ones(docs: DataFrame, model: Model | None, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, in a learned language; unknown texts go, and those between languages below ``least``."""

    def verdict(texts):
        label, score, unsure = decided(texts, model)
        return ((label != UNKNOWN) & ~(unsure & (score < least))).tolist()

    return rows_where(docs, text, verdict)


def op5_language(spark, sf_dir: str, learn_rows: int = 4000) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(learned(F.col("doc_id"), 3, 1)), learn_rows=learn_rows, seed=42)
    return languages(docs, model).select(
        "doc_id", held(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous"
    )
