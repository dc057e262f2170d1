"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or nothing (-) on every document.
Expectation-maximisation over the counts of vote patterns estimates, for each
labeller, how often it says what about good and about bad documents, and from
that the posterior of every pattern; no hand labels are used.  The number of
patterns is bounded by 3 to the number of labellers, so they come to the
driver whatever the input.  Posteriors of a bounded sample of documents
(``TRAIN_ROWS`` expected rows, at most twice as many and ``TRAIN_FEATURES``
features; the least hashes of id and text, equal rows once) train a hashed
linear scorer over words and word shapes, which scores every document.

Null and empty texts are one pattern like any other and score by their votes
alone.  Rows are scored one by one; repeated rows get equal scores, null ids
are kept and other columns are not read.  Very long texts are read whole.  An
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLERS = ("clean_words", "variety", "symbols", "capitals", "shouts", "endings", "repeats", "sentences", "bars")
TRAIN_ROWS = 6000
#: features of the sample, counted as the bytes of its texts and at most DIM a text (12 bytes each)
TRAIN_FEATURES = 24_000_000
DIM = 1 << 14
ROUNDS = 60
EPOCHS = 150
#: a document is kept from this score on
KEEP = 0.5
MEMO_WORDS = 400_000
#: words of a block of ``variety``, and the power of its length by which a text's distinct words grow
BLOCK, GROWTH = 400, 0.7

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
#: what may be left of a clean word without its letters
_MARKS = frozenset((b"", b".", b",", b";", b":", b"!", b"?", b"'", b"-", b"\"\"", b"()"))
_ENDS = (b".", b"!", b"?", b'"', b")", b":")
_SHAPE = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 else 57 if 48 <= b <= 57 else 117 if b >= 128 else b
               for b in range(256))


def variety(words: list[bytes]) -> float:
    """Share of distinct words; over ``BLOCK`` words the lower of two measures of
    the whole text: the mean share of consecutive blocks, and the distinct words
    against the number that a text of this length should have."""
    n = len(words)
    if n <= BLOCK:
        return len(set(words)) / n
    near = sum(len(set(words[i:i + BLOCK])) for i in range(0, n, BLOCK)) / n
    return min(near, len(set(words)) / (BLOCK * (n / BLOCK) ** GROWTH))


def votes(raw: bytes, words: list[bytes]) -> str:
    """One sign per labeller."""
    n = len(words)
    if n == 0:
        return "0" + "-" * (len(LABELLERS) - 1)
    chars = max(1, len(raw) - sum(raw.count(s) for s in (b" ", b"\n", b"\t")))

    def vote(value: float, bad: float, good: float) -> str:
        """0 from ``bad`` on, 1 up to ``good`` (either order)."""
        if bad > good:
            return "0" if value >= bad else "1" if value <= good else "-"
        return "0" if value <= bad else "1" if value >= good else "-"

    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    return "".join((
        vote(sum(w.translate(None, _LETTERS) in _MARKS for w in words) / n, 0.6, 0.9),
        vote(variety(words), 0.2, 0.45),
        vote((len(raw) - len(raw.translate(None, _SYMBOLS))) / chars, 0.05, 0.005),
        vote((len(raw) - len(raw.translate(None, _UPPER))) / chars, 0.4, 0.15),
        vote(raw.count(b"!!") / n, 0.2, 0.01),
        vote(sum(x.rstrip(_SPACES).endswith(_ENDS) for x in lines) / len(lines), 0.1, 0.6),
        vote(sum(map(bytes.__eq__, words, words[1:])) / n, 0.2, 0.02),
        vote(raw.count(b". ") + raw.count(b".\n") + raw.endswith(b"."), 0, 1) if n < 30
        else vote((raw.count(b". ") + raw.count(b".\n")) / n, 0.005, 0.02),
        vote(words.count(b"|") / n, 0.1, 0.0),
    ))


# ---- expectation-maximisation ------------------------------------------------------------------

def posteriors(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each vote pattern, accuracies (labeller x class x
    sign 0, 1, -) and the share of good documents, from pattern counts.

    Starts from the share of good votes, so that class 1 is the one the
    labellers call good."""
    if not patterns:
        return {}, np.full((len(LABELLERS), 2, 3), 1 / 3), 0.5
    names = sorted(patterns)
    weight = np.array([patterns[p] for p in names], dtype=float)
    sign = np.array([["01-".index(c) for c in p] for p in names])
    seen = np.eye(3)[sign]  # pattern x labeller x sign
    ones, zeros = (sign == 1).sum(axis=1), (sign == 0).sum(axis=1)
    # a bad vote is rare and tells more than a good one
    good = (ones + 1) / (ones + 3 * zeros + 2)
    share, rates = 0.5, None
    for _ in range(rounds):
        p = np.stack([1 - good, good])  # class x pattern
        share = float((weight * good).sum() / weight.sum())
        rates = np.einsum("cp,p,pls->lcs", p, weight, seen) + 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        log = np.einsum("pls,lcs->pc", seen, np.log(rates)) + np.log([max(1 - share, 1e-9), max(share, 1e-9)])
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return dict(zip(names, good.tolist())), rates, share


# ---- hashed linear scorer ----------------------------------------------------------------------

class Hasher:
    """Feature numbers of words, memoised: the word itself and its shape."""

    def __init__(self):
        self.memo: dict[bytes, tuple[int, int]] = {}

    def _new(self, w: bytes) -> tuple[int, int]:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        shape = w.translate(_SHAPE)
        kept = bytes(c for k, c in enumerate(shape) if k == 0 or c != shape[k - 1])[:16]
        got = zlib.crc32(w.lower()) % DIM, zlib.crc32(b"s:" + kept) % DIM
        self.memo[w] = got
        return got

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """(words + neighbours) x 1 feature numbers; equal neighbours have one of their own."""
        get, new = self.memo.get, self._new
        pairs = np.array([get(w) or new(w) for w in words], dtype=np.int32).reshape(-1, 2)
        same = int((pairs[1:, 0] == pairs[:-1, 0]).sum()) if len(pairs) > 1 else 0
        return np.concatenate([pairs.ravel(), np.full(same, zlib.crc32(b"same") % DIM, dtype=np.int32)])


_HASHER = Hasher()


def vote_numbers(signs: str) -> list[int]:
    """Votes are features too: one per labeller and sign."""
    return [zlib.crc32(f"v:{k}:{c}".encode()) % DIM for k, c in enumerate(signs)]


def vector(words: list[bytes], signs: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: shares of the words, and the votes."""
    numbers = _HASHER.numbers(words)
    ids, counts = np.unique(numbers, return_counts=True)
    extra = np.array(vote_numbers(signs), dtype=np.int32)
    values = np.concatenate([counts / max(1, len(words)), np.full(len(extra), 0.3)])
    return np.concatenate([ids, extra]), values


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS, rate: float = 0.05,
          penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on posterior labels (Adam, all rows each step)."""
    w, m, v = np.zeros(DIM + 1), np.zeros(DIM + 1), np.zeros(DIM + 1)
    if rows:
        ids = np.concatenate([r[0] for r in rows])
        values = np.concatenate([r[1] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        target = np.array([r[2] for r in rows])
        for step in range(1, epochs + 1):
            z = np.bincount(owner, weights=w[ids] * values, minlength=len(rows)) + w[DIM]
            err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / len(rows)
            g = np.append(np.bincount(ids, weights=err[owner] * values, minlength=DIM), err.sum())
            g += penalty * w
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return w[:DIM], float(w[DIM])


def score(words: list[bytes], signs: str, w: np.ndarray, bias: float) -> float:
    z = bias + 0.3 * w[vote_numbers(signs)].sum()
    if words:
        z += w[_HASHER.numbers(words)].sum() / len(words)
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


# ---- jobs --------------------------------------------------------------------------------------

def _votes_udf():
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            raw = (t.as_py() or "").encode()
            out.append(votes(raw, raw.split()))
        return pa.array(out, type=pa.string())
    return F.arrow_udf(run, "string").asNondeterministic()


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray, float]:
    """Posteriors by pattern, and the scorer's weights and bias."""
    marked = docs.select(_votes_udf()(docs["text"]).alias("votes"))
    patterns = {r.votes: r.n for r in marked.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    good, _, _ = posteriors(patterns)
    total = sum(patterns.values())
    # the share of hash values that gives train_rows rows; rows of one id and text are one row of the sample
    cut = int(min(1.0, train_rows / max(1, total)) * (1 << 62))
    hashed = docs.select(docs["text"].alias("text"), F.shiftrightunsigned(F.xxhash64(docs["doc_id"], docs["text"]), 2).alias("h"))
    chosen = hashed.filter(F.col("h") < cut).dropDuplicates(["h"])
    # least hashes first: at most twice train_rows rows and TRAIN_FEATURES features
    most = F.least(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(DIM)).alias("n")
    sizes = chosen.select("h", most).orderBy("h").limit(2 * train_rows).collect()
    fits = [r.h for r, n in zip(sizes, np.cumsum([r.n for r in sizes])) if n <= TRAIN_FEATURES]
    chosen = chosen.filter(F.col("h") <= (max(fits) if fits else -1))
    schema = pa.schema([("votes", pa.string()), ("ids", pa.list_(pa.int32())), ("vals", pa.list_(pa.float64()))])

    def vectors(batches):
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                raw = (t.as_py() or "").encode()
                words = raw.split()
                signs = votes(raw, words)
                rows.append((signs, *vector(words, signs)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], type=schema.types[k]) for k in range(3)], schema=schema)

    table = chosen.select("text").mapInArrow(
        vectors, "votes string, ids array<int>, vals array<double>").toArrow()
    sample = [(np.array(i), np.array(x), good[p]) for p, i, x in zip(
        table.column("votes").to_pylist(), table.column("ids").to_pylist(), table.column("vals").to_pylist()) if p in good]
    sample.sort(key=lambda r: (r[2], len(r[0]), r[0].tolist()[:8]))
    w, bias = train(sample)
    return good, w, bias


SCORED = "votes string, posterior double, score double"


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(row, q): all columns of ``docs`` and SCORED for every row."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    good, w, bias = fit(docs, train_rows)
    # at most 3 ** len(LABELLERS) patterns and DIM weights, whatever the input
    model = docs.sparkSession.sparkContext.broadcast((good, w, bias))
    kind = _parse_datatype_string(SCORED)
    arrow = to_arrow_type(kind)

    def run(texts: pa.Array) -> pa.Array:
        good, w, bias = model.value
        rows = []
        for t in texts:
            raw = (t.as_py() or "").encode()
            words = raw.split()
            signs = votes(raw, words)
            rows.append((signs, good.get(signs, 0.5), score(words, signs, w, bias)))
        cols = zip(*rows) if rows else [()] * 3
        return pa.StructArray.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, arrow)], fields=list(arrow))

    q = F.arrow_udf(run, kind).asNondeterministic()
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), q(docs["text"]).alias("q"))


def op3_weak_labels(docs: DataFrame) -> DataFrame:
    return classify(docs.select(docs["doc_id"], docs["text"])).select(
        F.col("row.doc_id").alias("doc_id"), "q.votes", F.round("q.posterior", 9).alias("posterior"),
        F.round("q.score", 9).alias("score"), (F.col("q.score") >= KEEP).alias("kept"))
