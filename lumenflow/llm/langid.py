"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its byte trigrams and 4-grams (hashed
into ``BUCKETS`` rows), classified by a linear softmax. Embeddings and softmax
are fitted together by stochastic gradient descent in numpy on the driver, over
a sample of at most ``SAMPLE`` labelled documents, whose n-gram counts are made
on the executors. At most ``CALIBRATION`` other labelled documents fit no
weights: they are scored on the executors, and their logits alone set the
softmax's temperature and the score under which a document is rejected, so that
of documents in a learned language a share of ``REJECTED`` falls under it.

The softmax has one more class, fitted on some of the sampled texts with their
characters shuffled: text whose n-grams belong to no learned language. What that
class takes, the languages' scores lose.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 2000
BITS = 15
BUCKETS = 2 << BITS
DIM = 16
EPOCHS = 5
RATE = 1.0
CALIBRATION = 10_000
FOLDS = 5  # one labelled document in so many, by the hash of its id, calibrates
SHUFFLED = 4  # one fitted document in so many also comes with its characters shuffled
REJECTED = 0.002  # share of rightly classified documents that falls under the threshold
BLOCK_BYTES = 1 << 20
UNKNOWN = "und"

#: ASCII other than letters counts as a space
_CLEAN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def normalise(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8").translate(_CLEAN).split()) + b"  "


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams and 4-grams that start at each byte but the last three."""
    b = raw.astype(np.uint32)
    g = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16)
    shift = np.uint32(32 - BITS)
    h3 = (g * np.uint32(0x9E3779B1)) >> shift
    h4 = ((g | b[3:] << np.uint32(24)) * np.uint32(0x85EBCA6B)) >> shift
    return h3, h4 + np.uint32(1 << BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of the whole text."""
    h3, h4 = grams(np.frombuffer(normalise(text), np.uint8))
    ids, counts = np.unique(np.concatenate((h3, h4)), return_counts=True)
    return ids.astype(np.int32), (counts / counts.sum()).astype(np.float32)


def shuffled(text: str) -> str:
    """The text's characters in an order that depends on the text only."""
    order = np.random.default_rng(xxhash.xxh64_intdigest(text.encode("utf-8"))).permutation(len(text)).tolist()
    return "".join(map(text.__getitem__, order))


@dataclass
class Model:
    langs: list[str]
    embeddings: np.ndarray  # (BUCKETS, d)
    weights: np.ndarray  # (d, langs + 1): the last class is no language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def projected(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows to sum up for each n-gram, what turns their mean into logits): the narrower of the two products."""
        if self.weights.shape[1] <= self.embeddings.shape[1]:
            return np.ascontiguousarray(self.embeddings @ self.weights, np.float32), np.eye(self.weights.shape[1])
        return self.embeddings, self.weights.astype(np.float64)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        """(rows, langs + 1) logits -> (rows, langs); what is missing to 1 is the share of no language."""
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return (z / z.sum(axis=1, keepdims=True))[:, : len(self.langs)]

    def calibrate(self, logits: np.ndarray, truth: np.ndarray, rejected: float = REJECTED) -> None:
        """Set temperature and threshold from (rows, langs + 1) logits of documents that fitted no weights; ``truth``: the
        number of each one's language, -1 for one that wasn't learned.

        The threshold is the floor((n + 1) * rejected)-th smallest score of the n rightly classified rows: another such
        document falls under it with at most the probability ``rejected``. With fewer than 1 / rejected rows it is the
        smallest score, and that probability is 1 / (n + 1).
        """
        known = np.flatnonzero(truth >= 0)
        if not len(known):
            return
        logits, truth = logits[known], truth[known]
        at, doubt = np.arange(len(truth)), 1 / (len(truth) + 1)  # labels are right in all but so many cases at best

        def loss(t: float) -> float:
            self.temperature = t
            logs = np.log(np.maximum(self.probabilities(logits), 1e-300))
            return -((1 - doubt) * logs[at, truth] + doubt * logs.mean(axis=1)).mean()

        self.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
        p = self.probabilities(logits)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        if len(right):
            self.threshold = float(right[max(0, int((len(right) + 1) * rejected) - 1)])

    def score(self, texts: list[str], rows: np.ndarray, out: np.ndarray) -> np.ndarray:
        """(texts, langs) probabilities; ``rows`` and ``out`` from projected()."""
        return self.probabilities(self.logits(texts, rows, out))

    def logits(self, texts: list[str], rows: np.ndarray, out: np.ndarray) -> np.ndarray:
        """(texts, langs + 1), without the bias."""
        raw = [normalise(t) for t in texts]
        h3, h4 = grams(np.frombuffer(b"".join(raw), np.uint8))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes) - sizes
        bounds = np.stack((starts, starts + sizes - 3), axis=1).reshape(-1)[:-1]  # n-grams that reach into the next text are left out
        sums = [np.add.reduceat(rows[h], bounds, axis=0)[::2] for h in (h3, h4)]
        mean = (sums[0].astype(np.float64) + sums[1]) / (2 * (sizes - 3))[:, None]
        return mean @ out


def fit(train: list[tuple[str | None, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """``train``: (language, or null for a shuffled text; buckets; shares). None if it has no language."""
    langs = sorted({x[0] for x in train} - {None})
    if not langs:
        return None
    number = {x: i for i, x in enumerate([*langs, None])}
    rng = np.random.default_rng(seed)
    # n-grams that were never seen keep an embedding of zero, so texts made of them score near chance
    e = np.zeros((BUCKETS, DIM), np.float32)
    w, bias = (rng.standard_normal((DIM, len(number))) / DIM**0.5).astype(np.float32), np.zeros(len(number), np.float32)
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            lang, ids, share = train[i]
            rate = RATE * (1 - step / steps)
            rows = e[ids]
            v = share @ rows
            z = v @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[lang]] -= 1
            back = w @ p
            w -= 0.1 * rate * np.outer(v, p)
            bias -= 0.01 * rate * p
            e[ids] = rows - (rate * len(ids) ** 0.5) * np.outer(share, back)  # a row's share falls as 1 / len(ids)
            step += 1
    return Model(langs, e, w, bias)


def held_out(ident: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of the texts with a letter, in groups of about BLOCK_BYTES."""
    own, held = [], 0
    for i, t in enumerate(texts):
        if has_letter(t):
            own.append(i)
            held += len(t)
            if held >= BLOCK_BYTES:
                yield own
                own, held = [], 0
    if own:
        yield own


def _smallest(rows: DataFrame, n: int) -> DataFrame | None:
    """Rows whose ``h`` is among the ``n`` smallest (more where hashes tie at the last), or None if there are no rows."""
    last = rows.select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return None if last is None else rows.filter(F.col("h") <= F.lit(last))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model | None:
    """Fit on the ``sample`` rows of ``labelled`` (language not null, text with a letter) with the smallest hashes of their
    ids, and calibrate on ``calibration`` rows, chosen likewise, of a FOLDS-th that is never fitted on; if either part is
    empty, the other stands for it.

    Ids' hashes are found first, so texts never reach the driver: of fitted rows it gets n-gram counts, of calibrating
    ones a number for each language. Rows without a language or a letter are left out; ids may be null or repeat; None
    if nothing is left.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    calibrates = F.pmod(F.xxhash64(F.lit("calibrates"), "h"), F.lit(FOLDS)) == 0
    fitted, held = _smallest(rows.filter(~calibrates), sample), _smallest(rows.filter(calibrates), calibration)
    fitted = held if fitted is None else fitted
    held = fitted if held is None else held
    if fitted is None:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows.append((h, lang, features(t)))
                if h % SHUFFLED == 0 and has_letter(t):
                    rows.append((h, None, features(shuffled(t))))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in rows], pa.int64()), pa.array([x for _, x, _ in rows], pa.string()), *[pa.array([f[k].tobytes() for _, _, f in rows], pa.binary()) for k in (0, 1)]], ["h", "lang", "ids", "share"])

    # where ids repeat more rows than the sample may share its last hash
    got = fitted.mapInArrow(counted, "h long, lang string, ids binary, share binary").orderBy("h", "lang", "ids").limit(2 * sample).collect()
    model = fit([(r["lang"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["share"], np.float32)) for r in got])
    table, out = model.projected()
    shared = labelled.sparkSession.sparkContext.broadcast((table, out))  # BUCKETS x min(DIM, languages + 1) floats

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
        for b in batches:
            texts, logits = b.column(1).to_pylist(), [b""] * b.num_rows
            for own in blocks(texts):
                for i, z in zip(own, blank.logits([texts[i] for i in own], *shared.value)):
                    logits[i] = z.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(logits, pa.binary())], ["h", "lang", "logits"])

    got = held.mapInArrow(scored, "h long, lang string, logits binary").filter("length(logits) > 0").orderBy("h", "lang", "logits").limit(calibration).collect()
    number = {x: i for i, x in enumerate(model.langs)}
    model.calibrate(np.array([np.frombuffer(r["logits"]) for r in got]).reshape(len(got), -1), np.array([number.get(r["lang"], -1) for r in got], np.int64))
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns, ``lang_pred`` string, ``score`` double and ``accepted`` boolean; columns of these names are replaced.

    Null texts, texts without a letter, and all texts if there is no model, get ``und`` with score 0 and are rejected;
    so are, under their language, texts that score below the model's threshold. Rows that repeat score alike; very long
    texts are read whole; an empty table gives no rows. One pass, no shuffle.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    at = kept.index(text_col)
    if model is None:
        return rows.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    table, out = model.projected()
    model = Model(model.langs, np.zeros((0, 0)), np.zeros((0, 0)), model.bias, model.temperature, model.threshold)
    names = rows.sparkSession.sparkContext.broadcast((model, table, out))  # BUCKETS x min(DIM, languages + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table, out = names.value
        for b in batches:
            texts = b.column(at).to_pylist()
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for own in blocks(texts):
                p = model.score([texts[i] for i in own], table, out)
                for i, best, value in zip(own, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    lang[i], score[i] = model.langs[best], value
            ok = [x != UNKNOWN and s >= model.threshold for x, s in zip(lang, score)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], schema.names)

    return rows.mapInArrow(run, schema)
