"""Personal data: base patterns, and a linear-chain conditional random field
over word-shape features for what they miss.

Base kinds, leftmost and non-overlapping per kind: email, ip (parts at most
255), card (14 to 19 digits passing Luhn), phone (10 to 15 digits); matches
that fail their test are dropped and not retried.

Field: tokens are runs of characters other than white space.  A token without
digit and ``@`` is outside by definition, which cuts a text into runs of
candidate tokens that can be decoded apart without changing the best path.
Tags are ``O`` and begin / inside of each kind.  Features are hashed: shape,
length, digits, marks, Luhn test, the tokens around.  The labelled table
(``tokens, before, after, tags``) is a bounded sample of runs
(``TRAIN_RUNS``) in order of a hash, tagged by the base patterns; weights are
fitted on the driver by gradient ascent of the conditional likelihood.
Viterbi decoding runs in numpy over batches of runs of similar length.  A
decoded span that overlaps a base span is dropped; base spans always stay.

Null and empty texts have no spans.  Rows are judged one by one, so repeated
rows get equal spans; other columns are not read.  A sample without runs gives
weights that tag everything ``O``.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: labelled runs the field is fitted on, and tokens of a run used there
TRAIN_RUNS = 4000
TRAIN_TOKENS = 64
DIM = 1 << 14
EPOCHS = 12

# ---- base patterns -----------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a digit run is entered at its first digit only: a later start in it cannot fare better
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_LOCAL_BACK = re.compile(r"[^A-Za-z0-9._%+-]")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each match holds one ``@``, so matches are grown from these: local
    characters to the left (not before the last match), domain to the right."""
    out = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1, start):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        floor = domain.end() if domain else at + 1
        if domain:
            out.append((start, domain.end()))
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), ordered by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.groups()]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def unsure_spans(text: str) -> list[tuple[int, int]]:
    """Places where a pattern matched and failed its test by its extent, as
    when a phone number runs on into other digits: their labels are not known."""
    out = [m.span() for m in _PHONE.finditer(text) if not 10 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out + [m.span() for m in _CARD.finditer(text) if len(_DIGITS.sub("", m.group())) > 19]


# ---- runs and features -------------------------------------------------------------------------

_CANDIDATE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^ \t\n\v\f\r]+")
_SHAPES = [(re.compile(p), r) for p, r in ((r"[A-Z]+", "X"), (r"[a-z]+", "x"), (r"[0-9]+", "9"), (r"[^\x00-\x7F]+", "u"))]
_LEAD, _TRAIL = "([{<\"'", ".,;:!?)]}>\"'"


def runs_of(text: str) -> list[tuple[list[tuple[int, int]], str, str]]:
    """Runs of neighbouring candidate tokens as code point spans, with the
    token before and after."""
    runs: list[list[tuple[int, int]]] = []
    place = 0
    last_end = -1
    while (hit := _CANDIDATE.search(text, place)) is not None:
        start = hit.start()
        while start > place and text[start - 1] not in " \t\n\v\f\r":
            start -= 1
        end = _TOKEN.match(text, start).end()
        joined = runs and not text[last_end:start].strip(" \t\n\v\f\r") and last_end >= 0
        if joined:
            runs[-1].append((start, end))
        else:
            runs.append([(start, end)])
        last_end = place = end
    out = []
    for run in runs:
        before = text[max(0, run[0][0] - 40):run[0][0]].split()
        after = text[run[-1][1]:run[-1][1] + 40].split()
        out.append((run, before[-1] if before else "", after[0] if after else ""))
    return out


def shape(token: str) -> str:
    for pattern, sign in _SHAPES:
        token = pattern.sub(sign, token)
    return token[:24]


def features(tokens: list[str], before: str, after: str) -> list[list[int]]:
    """Hashed features of each token of a run."""
    shapes = [shape(t) for t in tokens]
    out = []
    for i, t in enumerate(tokens):
        digits = _DIGITS.sub("", t)
        left = tokens[i - 1] if i else before
        right = tokens[i + 1] if i + 1 < len(tokens) else after
        core = t.strip(_LEAD + _TRAIL)
        named = (
            "bias", "s=" + shapes[i], "core=" + shape(core), "n=%d" % min(len(digits), 20), "l=%d" % min(len(t), 24),
            "dots=%d" % min(t.count("."), 5), "at=%d" % min(t.count("@"), 2), "plus=%d" % t.startswith("+"),
            "luhn=%d" % (14 <= len(digits) <= 19 and luhn(digits)),
            "hex=%d" % (len(core) >= 16 and re.fullmatch("[0-9a-f]+", core) is not None),
            "ls=" + (shapes[i - 1] if i else "^" + shape(before)),
            "rs=" + (shapes[i + 1] if i + 1 < len(tokens) else "$" + shape(after)),
            "lw=" + left.lower()[:16], "rw=" + right.lower()[:16], "pos=%d" % min(i, 4), "left=%d" % min(len(tokens) - i, 5),
        )
        out.append([zlib.crc32(f.encode()) % DIM for f in named])
    return out


def run_tags(run: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Tag of each token of a run from the spans it overlaps."""
    tags = [0] * len(run)
    for start, kind, end in spans:
        inside = [i for i, (a, b) in enumerate(run) if a < end and b > start]
        for n, i in enumerate(inside):
            if tags[i] == 0:
                tags[i] = 1 + 2 * kind + (n > 0)
    return tags


# ---- the field ---------------------------------------------------------------------------------

class Field:
    """Weights of the chain: ``emit`` (features x tags), ``move`` (tags x tags),
    ``start`` and ``stop`` (tags).  Inside tags follow their own kind only."""

    def __init__(self):
        k = len(TAGS)
        self.emit = np.zeros((DIM, k))
        self.move, self.start, self.stop = np.zeros((k, k)), np.zeros(k), np.zeros(k)
        self.barred = np.zeros((k, k))
        self.barred_start = np.zeros(k)
        for kind in range(len(KINDS)):
            i = 2 + 2 * kind
            self.barred[:, i] = self.barred_start[i] = -1e4
            self.barred[i, i] = self.barred[i - 1, i] = 0

    def _scores(self, feats: np.ndarray, move: np.ndarray) -> np.ndarray:
        return self.emit[feats].sum(axis=2)

    def fit(self, runs: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS, rate: float = 0.2,
            penalty: float = 1e-4, batch: int = 128) -> "Field":
        """AdaGrad on the negative conditional log-likelihood, in the order given."""
        if not runs:
            return self
        by_length: dict[int, list[int]] = {}
        for i, (f, _) in enumerate(runs):
            by_length.setdefault(len(f), []).append(i)
        batches = [ids[k:k + batch] for _, ids in sorted(by_length.items()) for k in range(0, len(ids), batch)]
        order = np.random.default_rng(7)
        squares = [np.full_like(w, 1e-3) for w in (self.emit, self.move, self.start, self.stop)]
        for _ in range(epochs):
            for b in order.permutation(len(batches)):
                feats = np.array([runs[i][0] for i in batches[b]])
                tags = np.array([runs[i][1] for i in batches[b]])
                for w, g, s in zip((self.emit, self.move, self.start, self.stop), self._gradient(feats, tags), squares):
                    g = g / len(tags) + penalty * w
                    s += g * g
                    w -= rate * g / np.sqrt(s)
        return self

    def _gradient(self, feats: np.ndarray, tags: np.ndarray):
        """Expected minus observed counts, by the forward-backward recursion."""
        n, length, k = len(tags), tags.shape[1], len(TAGS)
        move, start = self.move + self.barred, self.start + self.barred_start
        e = self.emit[feats].sum(axis=2)
        fw, bw = np.empty((length, n, k)), np.empty((length, n, k))
        fw[0] = start + e[:, 0]
        for t in range(1, length):
            fw[t] = _logsum(fw[t - 1][:, :, None] + move, 1) + e[:, t]
        bw[-1] = self.stop
        for t in range(length - 2, -1, -1):
            bw[t] = _logsum(move[None] + (e[:, t + 1] + bw[t + 1])[:, None, :], 2)
        total = _logsum(fw[-1] + self.stop, 1)
        g_emit, g_move = np.zeros_like(self.emit), np.zeros_like(self.move)
        rows = np.arange(n)
        for t in range(length):
            p = np.exp(fw[t] + bw[t] - total[:, None])
            p[rows, tags[:, t]] -= 1
            for j in range(feats.shape[2]):
                np.add.at(g_emit, feats[:, t, j], p)
            if t:
                pair = np.exp(fw[t - 1][:, :, None] + move + (e[:, t] + bw[t])[:, None, :] - total[:, None, None])
                g_move += pair.sum(axis=0)
                np.add.at(g_move, (tags[:, t - 1], tags[:, t]), -1)
            if t == 0:
                g_start = p.sum(axis=0)
            if t == length - 1:
                g_stop = p.sum(axis=0)
        return g_emit, g_move, g_start, g_stop

    def decode(self, runs: list[list[list[int]]], cells: int = 1 << 15) -> list[list[int]]:
        """Best tags of each run; runs of similar length are decoded together,
        padded, at most ``cells`` tokens at once (a longer run alone)."""
        out: list[list[int]] = [[] for _ in runs]
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(runs[order[stop]]) * (stop + 1 - at) <= cells:
                stop += 1
            ids = order[at:stop]
            for i, tags in zip(ids, self._viterbi([runs[i] for i in ids])):
                out[i] = tags
            at = stop
        return out

    def _viterbi(self, runs: list[list[list[int]]]) -> list[list[int]]:
        n, k = len(runs), len(TAGS)
        lengths = np.array([len(r) for r in runs])
        longest = int(lengths.max())
        e = np.zeros((longest, n, k))
        for i, r in enumerate(runs):
            e[:len(r), i] = self.emit[np.array(r)].sum(axis=1)
        move = self.move + self.barred
        back = np.zeros((longest, n, k), dtype=np.int8)
        best = self.start + self.barred_start + e[0]
        for t in range(1, longest):
            go = best[:, :, None] + move
            back[t] = go.argmax(axis=1)
            step = go.max(axis=1) + e[t]
            live = (t < lengths)[:, None]
            best = np.where(live, step, best)
        tag = (best + self.stop).argmax(axis=1)
        path = np.zeros((longest, n), dtype=np.int64)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            path[t] = tag
            if t:
                tag = np.where(t < lengths, back[t][rows, tag], tag)
        return [path[:length, i].tolist() for i, length in enumerate(lengths)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


# ---- spans -------------------------------------------------------------------------------------

def spans_from_tags(text: str, run: list[tuple[int, int]], tags: list[int]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of tagged stretches, without marks around them."""
    out: list[list[int]] = []
    for (a, b), tag in zip(run, tags):
        if tag == 0:
            continue
        kind, inside = (tag - 1) // 2, (tag - 1) % 2
        if inside and out and out[-1][1] == kind:
            out[-1][2] = b
        else:
            out.append([a, kind, b])
    trimmed = []
    for a, kind, b in out:
        while a < b and text[a] in _LEAD and not (kind == 3 and text[a] == "("):
            a += 1
        while b > a and text[b - 1] in _TRAIL:
            b -= 1
        if a < b:
            trimmed.append((a, kind, b))
    return trimmed


def find_batch(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    found = []
    feats, owners = [], []
    for i, text in enumerate(texts):
        if _CANDIDATE.search(text) is None:
            found.append(([], []))
            continue
        base = base_spans(text)
        found.append((base, list(base)))
        for run, before, after in runs_of(text):
            feats.append(features([text[a:b] for a, b in run], before, after))
            owners.append((i, run))
    for (i, run), tags in zip(owners, field.decode(feats)):
        base, every = found[i]
        for a, kind, b in spans_from_tags(texts[i], run, tags):
            if not any(s < b and e > a for s, _, e in base):
                every.append((a, kind, b))
    return [(base, sorted(every)) for base, every in found]


def label_runs(docs: DataFrame, limit: int = TRAIN_RUNS) -> DataFrame:
    """Labelled table (tokens, before, after, tags): ``limit`` runs, those with
    the smallest hashes, tagged by the base patterns.  Of a longer run the first
    ``TRAIN_TOKENS`` tokens make the row, with the next one as right neighbour."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    kind = _parse_datatype_string("array<struct<tokens:array<string>,before:string,after:string,tags:array<int>>>")
    arrow = to_arrow_type(kind)

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            spans, unsure = base_spans(t), unsure_spans(t)
            rows.append([{"tokens": [t[a:b] for a, b in r[:TRAIN_TOKENS]], "before": before,
                          # a run cut short is followed by its own next token
                          "after": t[r[TRAIN_TOKENS][0]:r[TRAIN_TOKENS][1]] if len(r) > TRAIN_TOKENS else after,
                          "tags": run_tags(r[:TRAIN_TOKENS], spans)} for r, before, after in runs_of(t)
                         if not any(a < r[-1][1] and b > r[0][0] for a, b in unsure)])
        return pa.array(rows, type=arrow)

    marked = docs.select(docs["text"].alias("text")).filter(F.col("text").rlike("[0-9@]"))
    runs = marked.select(F.explode(F.arrow_udf(run, kind)("text")).alias("r")).select("r.*")
    # equal runs are one row of the table: copies of a text do not weigh more
    return runs.distinct().orderBy(F.xxhash64("tokens", "before", "after"), "tokens", "before", "after").limit(limit)


def train_field(labelled: DataFrame) -> Field:
    """Field fitted on a small labelled table, which comes to the driver."""
    rows = labelled.collect()
    return Field().fit([(features(r.tokens, r.before, r.after), list(r.tags)) for r in rows])


SPANS = "base array<struct<start:int,kind:int,end:int>>, spans array<struct<start:int,kind:int,end:int>>"


def _field(weights) -> Field:
    field = Field()
    field.emit, field.move, field.start, field.stop = weights.value
    return field


def _spans_udf(weights):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    kind = _parse_datatype_string(SPANS)
    arrow = to_arrow_type(kind)

    def row(spans):
        return [{"start": a, "kind": k, "end": b} for a, k, b in spans]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([{"base": row(base), "spans": row(every)}
                         for base, every in find_batch([t or "" for t in texts.to_pylist()], _field(weights))], type=arrow)

    return F.arrow_udf(run, kind).asNondeterministic()


def _weights(docs: DataFrame, labelled: DataFrame | None):
    """Broadcast weights (a fixed size) of the field fitted on ``labelled``, or
    on the labelled sample of ``docs``."""
    field = train_field(label_runs(docs) if labelled is None else labelled)
    return docs.sparkSession.sparkContext.broadcast((field.emit, field.move, field.start, field.stop))


def _candidates(docs: DataFrame) -> DataFrame:
    """(row, candidate): all columns, and the text where it has a digit or ``@``;
    other texts are not sent to Python."""
    text = docs["text"]
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       F.when(text.rlike("[0-9@]"), text).alias("candidate"))


def describe(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _listed(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_crf_pii(docs: DataFrame) -> DataFrame:
    find = _spans_udf(_weights(docs, None))
    found = _candidates(docs.select(docs["doc_id"], docs["text"])).select("row", find("candidate").alias("found"))
    base, spans = F.col("found.base"), F.col("found.spans")
    # a second parameter of the lambda would be the span's index
    def of(k):
        return lambda s: s["kind"] == k
    count = [F.size(F.filter(base, of(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(F.col("row.doc_id").alias("doc_id"), *count,
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"),
                        (F.size(spans) - F.size(base)).cast("bigint").alias("n_added"))


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans are replaced as one, named by the first."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` counted
    anew; all rows and columns stay."""
    weights = _weights(docs, labelled)

    def run(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        found = find_batch([t or "" for t in rows], _field(weights))
        return pa.array([t if t is None else redact_text(t, spans) for t, (_, spans) in zip(rows, found)], type=pa.string())

    clean = F.arrow_udf(run, "string").asNondeterministic()
    done = _candidates(docs).select("row", clean("candidate").alias("t")).select(
        "row", F.coalesce("t", F.col("row").getField("text")).alias("t"))
    return done.select(*[
        F.col("t").alias(c) if c == "text" else F.length("t").cast("bigint").alias(c) if c == "n_chars"
        else F.col("row").getField(c).alias(c) for c in docs.columns])
