"""Edit-aware token counts.

Per document a segment tree is kept over leaves of ``LEAF_WORDS`` white-space
separated pre-tokens and at most about ``LEAF_CHARS`` characters: every node
has the characters and the tokens below it.  The tree is two arrays and can be
stored beside the text (``index_documents``).  An edit replaces characters
``[start, end)`` by a string.  It goes down the tree to the leaves it touches,
changes their text and the character sums on the way up.  All edits of a leaf
are applied before it is counted.  Then the touched regions grow to borders
over which the encoder never merges (white space, or a digit between ASCII
characters), every region is encoded once, and its token sums go up the tree.
All other leaves keep their counts.

A word longer than a leaf is cut at such borders, and where it has none, into
leaves that form one run: the run is encoded as a whole, and its first leaf has
its tokens.  So edits cost the leaves they touch, and counting costs the runs
they touch once, however many edits there are.

Edits of a document apply in the order given, each to the text the ones before
it left; places beyond the text are drawn in to its end.  Null texts count as
empty, null edits as none.  Rows are counted one by one; repeated rows get
equal counts, an empty table gives an empty result, and other columns are not
read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.encoder import WordEncoder, encoder, vocabulary

LEAF_WORDS = 48
LEAF_CHARS = 2048
#: white space of the encoder's word split
_SPACE = " \t\n\v\f\r"
_BORDER = re.compile(r"[ \t\n\v\f\r]+")


#: places between two ASCII characters of which one is a digit
_DIGIT = re.compile(r"(?<=[0-9])(?=[\x00-\x7F])|(?<=[\x00-\x7F])(?=[0-9])")


def parted(before: str, after: str) -> bool:
    """Whether the encoder never merges over the border of two texts."""
    a, b = before[-1:], after[:1]
    return a in _SPACE or b in _SPACE or a.isascii() and b.isascii() and (a.isdigit() or b.isdigit())


def leaf_starts(text: str, leaf_words: int = LEAF_WORDS, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Starts of the leaves: the first one at 0, the others after white space,
    and inside leaves of more than ``leaf_chars`` where these are cut."""
    starts = [0]
    for n, m in enumerate(_BORDER.finditer(text), 1):
        if n % leaf_words == 0 and m.end() < len(text):
            starts.append(m.end())
    if len(text) <= leaf_chars:
        return starts
    out = []
    for a, b in zip(starts, starts[1:] + [len(text)]):
        out.append(a)
        while b - out[-1] > leaf_chars:
            at = out[-1]
            cuts = [m.end() for border in (_BORDER, _DIGIT) for m in border.finditer(text, at + leaf_chars // 2, at + leaf_chars)]
            out.append(max(cuts, default=at + leaf_chars))
    return out


def runs_of(leaves: list[str]) -> list[list[int]]:
    """Numbers of the non-empty leaves, in runs between borders."""
    runs: list[list[int]] = []
    before = " "
    for k, leaf in enumerate(leaves):
        if leaf:
            if parted(before, leaf):
                runs.append([])
            runs[-1].append(k)
            before = leaf
    return runs


class CountTree:
    """Segment tree of (characters, tokens) over the leaves of a text."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.size = max(1, len(chars) // 2)
        self.chars, self.tokens = chars, tokens

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> "CountTree":
        size = 1 << max(0, (len(chars) - 1).bit_length())
        sums = []
        for values in (chars, tokens):
            a = np.zeros(2 * size, dtype=np.int64)
            a[size:size + len(values)] = values
            width = size
            while width > 1:
                half = width // 2
                a[half:width] = a[width:2 * width:2] + a[width + 1:2 * width:2]
                width = half
            sums.append(a)
        return cls(*sums)

    @property
    def total(self) -> int:
        return int(self.tokens[1]) if len(self.tokens) > 1 else 0

    def find(self, place: int) -> tuple[int, int]:
        """Leaf that holds character ``place`` and where it starts; the last
        non-empty leaf for the text's end."""
        place = min(place, max(0, int(self.chars[1]) - 1))
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if place >= start + self.chars[k]:
                start += int(self.chars[k])
                k += 1
        return k - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.size
        dc, dt = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += dc
            self.tokens[k] += dt
            k //= 2


def build_tree(text: str, words: WordEncoder, leaf_words: int = LEAF_WORDS, leaf_chars: int = LEAF_CHARS) -> CountTree:
    starts = leaf_starts(text, leaf_words, leaf_chars)
    chars = np.diff(starts + [len(text)])
    if len(starts) == 1:
        return CountTree.of([len(text)], [words.token_count(text)])
    leaves = [text[a:a + n] for a, n in zip(starts, chars.tolist())]
    tokens = [0] * len(leaves)
    if len(text) > leaf_chars:
        runs = runs_of(leaves)
    else:
        runs = [[k] for k in range(len(leaves))]
    for run, n in zip(runs, words.token_counts(["".join(leaves[run[0]:run[-1] + 1]) for run in runs])):
        tokens[run[0]] = n
    return CountTree.of(chars.tolist(), tokens)


class EditedText:
    """A text under edits with its tree; leaves are kept as strings.  Token
    sums hold after ``settle``."""

    def __init__(self, text: str, tree: CountTree, words: WordEncoder):
        self.tree, self.words = tree, words
        self.leaves, at = [], 0
        for n in tree.chars[tree.size:].tolist():
            self.leaves.append(text[at:at + n])
            at += n
        #: leaves that had one run with the leaf before, when last counted
        self.glued = np.zeros(len(self.leaves) + 1, dtype=bool)
        for run in runs_of(self.leaves):
            self.glued[run[0] + 1:run[-1] + 1] = True
        self.touched: set[int] = set()
        self.encoded_chars = 0

    def edit(self, start: int, end: int, new: str) -> None:
        tree, leaves = self.tree, self.leaves
        length = int(tree.chars[1])
        start = min(max(0, start), length)
        end = min(max(start, end), length)
        first, at = tree.find(start)
        last, last_at = tree.find(max(start, end - 1))
        region = leaves[first][:start - at] + new + leaves[last][end - last_at:]
        for leaf in range(first, last + 1):
            leaves[leaf] = region if leaf == first else ""
            tree.put(leaf, len(leaves[leaf]), int(tree.tokens[leaf + tree.size]))
        self.touched.update(range(first, last + 1))

    def settle(self) -> None:
        """Counts every run that an edit touched, and all that shared a run
        with one of its leaves before."""
        if not self.touched:
            return
        leaves, tree = self.leaves, self.tree
        runs = runs_of(leaves)
        # runs by number; an empty leaf touches the runs at both sides of it
        run_of = np.zeros(len(leaves), dtype=np.int64)
        for r, run in enumerate(runs):
            run_of[run] = r
        old = np.cumsum(~self.glued[:-1])
        members: dict[int, list[int]] = {}
        for k, o in enumerate(old.tolist()):
            members.setdefault(o, []).append(k)
        todo, seen, again = list(self.touched), set(self.touched), set()
        filled = np.array([k for run in runs for k in run], dtype=np.int64)
        while todo:
            k = todo.pop()
            more = list(members[int(old[k])])
            if leaves[k]:
                near = [int(run_of[k])]
            else:
                at = int(np.searchsorted(filled, k))
                near = [int(run_of[filled[j]]) for j in (at - 1, at) if 0 <= j < len(filled)]
                near = near if len(set(near)) == 1 else []  # parted where the leaf was: nothing grew together
            for r in near:
                if r not in again:
                    again.add(r)
                    more += runs[r]
            todo += [m for m in more if m not in seen]
            seen.update(more)
        texts = ["".join(leaves[k] for k in runs[r]) for r in sorted(again)]
        self.encoded_chars += sum(map(len, texts))
        tokens = dict(zip((runs[r][0] for r in sorted(again)), self.words.token_counts(texts)))
        for k in seen:
            tree.put(k, len(leaves[k]), tokens.get(k, 0))
            self.glued[k] = False
        for r in again:
            self.glued[runs[r][0] + 1:runs[r][-1] + 1] = True
        self.touched = set()

    @property
    def text(self) -> str:
        return "".join(self.leaves)


COUNTED = "n_tokens_before bigint, n_edits bigint, n_tokens bigint, n_leaves bigint, encoded_chars bigint, n_chars bigint"
EDITS = "array<struct<start:int,end:int,new:string>>"


def index_documents(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """(doc_id, chars, tokens): the tree of each document."""
    vocab = vocab or vocabulary()
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    kind = _parse_datatype_string("chars array<bigint>, tokens array<bigint>")
    arrow = to_arrow_type(kind)

    def run(texts: pa.Array) -> pa.Array:
        words = encoder(vocab)
        trees = [build_tree(t.as_py() or "", words) for t in texts]
        return pa.array([{"chars": t.chars.tolist(), "tokens": t.tokens.tolist()} for t in trees], type=arrow)

    return docs.select(docs["doc_id"], F.arrow_udf(run, kind).asNondeterministic()(docs["text"]).alias("t")).select(
        "doc_id", "t.chars", "t.tokens")


def count_after_edits(text: Column, edits: Column, tree: Column | None = None, vocab: str | None = None) -> Column:
    """COUNTED of a text after its edits.  ``tree`` is a struct (chars, tokens)
    from ``index_documents``; without it the tree is built on the way."""
    vocab = vocab or vocabulary()
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    kind = _parse_datatype_string(COUNTED)
    arrow = to_arrow_type(kind)
    names = [f.name for f in kind.fields]

    def count(words, text, changes, stored):
        if stored is None:
            tree = build_tree(text, words)
        else:
            tree = CountTree(np.array(stored["chars"], dtype=np.int64), np.array(stored["tokens"], dtype=np.int64))
        before, leaves = tree.total, int(np.count_nonzero(tree.chars[tree.size:]))
        if not changes:
            return before, 0, before, leaves, 0, len(text)
        edited = EditedText(text, tree, words)
        for e in changes:
            edited.edit(e["start"], e["end"], e["new"] or "")
        edited.settle()
        return before, len(changes), tree.total, leaves, edited.encoded_chars, int(tree.chars[1])

    def run(texts: pa.Array, edits: pa.Array, *trees: pa.Array) -> pa.Array:
        words = encoder(vocab)
        stored = trees[0].to_pylist() if trees else [None] * len(texts)
        rows = [count(words, t.as_py() or "", e.as_py(), s) for t, e, s in zip(texts, edits, stored)]
        return pa.StructArray.from_arrays(
            [pa.array(list(c), type=pa.int64()) for c in (zip(*rows) if rows else [()] * len(names))], fields=list(arrow))

    args = [text, edits] + ([tree] if tree is not None else [])
    return F.arrow_udf(run, kind).asNondeterministic()(*args)


# ---- edits of the query ------------------------------------------------------------------------

_MAIL = re.compile(r"(?<![^ \t\n])[^ \t\n@]+@[^ \t\n@]+")
_LONG_NUMBER = re.compile(r"[0-9]{5,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits of a cleaning pass: lines equal to an earlier line go, words
    with ``@`` become ``<mail>``, numbers of five or more digits ``<number>``;
    last place first, so that places stay right."""
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line and line in seen:
            out.append((at, min(at + len(line) + 1, len(text)), ""))
        seen.add(line)
        at += len(line) + 1
    if "@" in text:
        for m in _MAIL.finditer(text):
            out.append((m.start(), m.end(), "<mail>"))
    for m in _LONG_NUMBER.finditer(text):
        out.append((m.start(), m.end(), "<number>"))
    # an edit inside one that is already there is dropped
    out.sort(key=lambda e: (e[0], -e[1]))
    kept: list[tuple[int, int, str]] = []
    for e in out:
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept[::-1]


def edits_of(text: Column) -> Column:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    kind = _parse_datatype_string(EDITS)
    arrow = to_arrow_type(kind)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b, "new": s} for a, b, s in cleaning_edits(t.as_py() or "")]
                         for t in texts], type=arrow)
    return F.arrow_udf(run, kind).asNondeterministic()(text)


def op1_edit_counts(docs: DataFrame) -> DataFrame:
    """Token counts of all documents before and after a cleaning pass, the
    second from the tree of the first."""
    rows = docs.select(docs["doc_id"], docs["text"], edits_of(docs["text"]).alias("edits"))
    return rows.select("doc_id", count_after_edits(F.col("text"), F.col("edits")).alias("c")).select("doc_id", "c.*")
