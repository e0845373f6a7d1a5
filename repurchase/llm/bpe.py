"""BPE encoding by tree concatenation, and decoding.

A text longer than a leaf is cut in the middle, whatever is there, until the pieces are leaves. Leaves are encoded on
their own; going up the tree, a window around each join is encoded anew and grows until it holds, on either side, a
token that the piece of that side has at the same place with the same id. Neighbouring tokens decide whether an
encoding is the encoder's own, so the left piece up to its token, the window between both, and the right piece from
its token on form exactly the encoding of the joined text. Texts above ``SPREAD_CHARS`` have their leaves encoded by
different tasks.

Within a leaf, words (split by the white space that the tokenizer itself drops) are looked up in a bounded memory of
words seen before; unknown ones go through the tokenizers library.

Defined results: a null text is empty; an empty text, or one of white space only, has no tokens and decodes to
nothing; rows that repeat an id are encoded row by row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import combining, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repurchase.llm.storage import stored

LEAF_CHARS = 8192
SPREAD_CHARS = 65_536
# At least the length of the longest special token, so that a window sees whole the ones that a cut divides.
FIRST_WINDOW = 32
# Words kept in memory by each worker, in two generations: a full one becomes the older one, and words looked up
# again move to the younger.
KNOWN_WORDS = 150_000
# White space in the tokenizer's sense. str.split() also splits at the four separators below.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
RUN = re.compile("[^" + "".join(map(chr, SPACES)) + "]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def safe(text: str, at: int, bound: int, step: int) -> int:
    """The next place from ``at`` towards ``bound`` where Unicode composition does not reach across."""
    while at != bound:
        x, y = text[at - 1], text[at]
        if x < "\u0300" and y < "\u0300":
            break
        if not combining(y) and normalize("NFC", x + y) == normalize("NFC", x) + normalize("NFC", y):
            break
        at += step
    return at


class Piece:
    """Words of a stretch of text: where they start and end, and their (ids, tokens, count); ids and tokens as text.

    The entry of a joint also has the ids and places of its tokens.
    """

    __slots__ = ("starts", "ends", "entries")

    def __init__(self, starts: list, ends: list, entries: list):
        self.starts, self.ends, self.entries = starts, ends, entries

    def __add__(self, other: Piece) -> Piece:
        return Piece(self.starts + other.starts, self.ends + other.ends, self.entries + other.entries)


class Encoder:
    def __init__(self, path: str, leaf: int = LEAF_CHARS, window: int = FIRST_WINDOW):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.window, self.known, self.older = leaf, window, {}, {}
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]

    def entries(self, words: list[str]) -> list[tuple]:
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        known, older, names = self.known, self.older, self.names
        new = []
        for word in set(words).difference(known):
            entry = older.get(word)
            if entry is None:
                new.append(word)
            else:
                known[word] = entry
        for word, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            ids = e.ids
            known[word] = (" ".join([str(i) for i in ids]), " ".join([names[i] for i in ids]), len(ids))
        return [known[w] for w in words]

    def leaf_piece(self, text: str, a: int, b: int) -> Piece:
        runs = list(RUN.finditer(text, a, b))
        return Piece([m.start() for m in runs], [m.end() for m in runs], self.entries([m[0] for m in runs]))

    def places(self, text: str, piece: Piece, i: int) -> list[tuple[int, int, int, str]]:
        """The tokens of word i as (start, end, id, token)."""
        entry, at = piece.entries[i], piece.starts[i]
        if len(entry) > 3:
            return entry[3]
        e = self.tokenizer.encode(text[at : piece.ends[i]], add_special_tokens=False)
        return [(at + s, at + t, n, k) for (s, t), n, k in zip(e.offsets, e.ids, e.tokens)]

    @staticmethod
    def seam(tokens: list[tuple]) -> Piece:
        if not tokens:
            return Piece([], [], [])
        entry = (" ".join(str(t[2]) for t in tokens), " ".join(t[3] for t in tokens), len(tokens), tokens)
        return Piece([tokens[0][0]], [tokens[-1][1]], [entry])

    def join(self, text: str, left: Piece, right: Piece, a: int, m: int, b: int) -> Piece:
        """The encoding of text[a:b] from those of text[a:m] and text[m:b]."""
        width = self.window
        while True:
            low, high = safe(text, max(a, m - width), a, -1), safe(text, min(b, m + width), b, 1)
            e = self.tokenizer.encode(text[low:high], add_special_tokens=False)
            middle = [(low + s, low + t, n, k) for (s, t), n, k in zip(e.offsets, e.ids, e.tokens)]
            index = {t[:3]: i for i, t in enumerate(middle)}
            # On the left: the last token of the left piece that the window has too. Tokens that touch the cut or
            # an edge of the window do not count, nor do those whose neighbour shares a character with them.
            keep_left, head, first = (0, [], 0) if low == a else (None, None, None)
            if low > a:
                i = len(left.starts) - 1
                while i >= 0 and left.ends[i] > low and keep_left is None:
                    tokens = self.places(text, left, i)
                    for j in range(len(tokens) - 1, -1, -1):
                        t = tokens[j]
                        whole = j + 1 == len(tokens) or tokens[j + 1][0] >= t[1]
                        at = index.get(t[:3]) if whole and t[1] < m and t[0] > low else None
                        if at is not None and (at + 1 == len(middle) or middle[at + 1][0] >= t[1]):
                            keep_left, head, first = i, tokens[: j + 1], at + 1
                            break
                    i -= 1
            keep_right, tail, last = (len(right.starts), [], len(middle)) if high == b else (None, None, None)
            if high < b:
                i = 0
                while i < len(right.starts) and right.starts[i] < high and keep_right is None:
                    tokens = self.places(text, right, i)
                    for j, t in enumerate(tokens):
                        whole = j == 0 or tokens[j - 1][1] <= t[0]
                        at = index.get(t[:3]) if whole and t[0] > m and t[1] < high else None
                        if at is not None and (at == 0 or middle[at - 1][1] <= t[0]):
                            keep_right, tail, last = i + 1, tokens[j:], at
                            break
                    i += 1
            if keep_left is not None and keep_right is not None and first <= last:
                joint = self.seam(head + middle[first:last] + tail)
                before = Piece(left.starts[:keep_left], left.ends[:keep_left], left.entries[:keep_left])
                after = Piece(right.starts[keep_right:], right.ends[keep_right:], right.entries[keep_right:])
                return before + joint + after
            width *= 2

    def tree(self, text: str, a: int, b: int) -> Piece:
        if b - a <= self.leaf:
            return self.leaf_piece(text, a, b)
        m = safe(text, (a + b) // 2, a, -1)
        if m == a:
            m = safe(text, (a + b) // 2, b, 1)
        if m == b:
            return self.leaf_piece(text, a, b)
        return self.join(text, self.tree(text, a, m), self.tree(text, m, b), a, m, b)

    def encode(self, text: str) -> list[tuple]:
        """Entries (ids, tokens, count) in order."""
        if len(text) > self.leaf:
            return self.tree(text, 0, len(text)).entries
        return self.entries(RUN.findall(text) if SEPARATORS.search(text) else text.split())


@lru_cache(maxsize=2)
def encoder(path: str, leaf: int = LEAF_CHARS) -> Encoder:
    """One encoder, with its known words, for all tasks of a worker."""
    return Encoder(path, leaf)


def ids_of(entries: list[tuple]) -> str:
    return " ".join([e[0] for e in entries if e[2]])


def decoded(entries: list[tuple]) -> str:
    """The tokenizer file names no decoder, so the library joins the tokens with spaces."""
    return " ".join([e[1] for e in entries if e[2]])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _outputs(texts: list[list[tuple]], outputs: str) -> list[pa.Array]:
    counts = pa.array([sum([e[2] for e in x]) for x in texts], pa.int64())
    if outputs == "decoded":
        return [counts, pa.array([decoded(x) for x in texts], pa.string())]
    if outputs == "digests":
        return [counts, pa.array([_sha(ids_of(x)) for x in texts], pa.string()), pa.array([_sha(decoded(x)) for x in texts], pa.string())]
    ids = [np.array(ids_of(x).split(), dtype=np.int32) for x in texts]
    ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.array([], dtype=np.int32)
    return [counts, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]


#: what encode_documents can add to n_tokens
OUTPUTS = {
    "ids": [T.StructField("ids", T.ArrayType(T.IntegerType()))],
    "decoded": [T.StructField("decoded", T.StringType())],
    "digests": [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())],
}


def _fields(outputs: str) -> list[T.StructField]:
    return [T.StructField("n_tokens", T.LongType()), *OUTPUTS[outputs]]


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode_documents(
    documents: DataFrame, *keep: str, path: str | None = None, outputs: str = "ids", leaf: int = LEAF_CHARS,
    spread: int = SPREAD_CHARS,
) -> DataFrame:
    """The kept columns and n_tokens of every row, with its ids, its decoded text, or the SHA-256 digests of both."""
    path = path or default_path()
    keep = keep or ("doc_id",)
    rows = documents.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    out = T.StructType(kept + _fields(outputs))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, leaf)
        for whole in batches:
            for batch in _slices(whole):
                texts = [own.encode(t) for t in batch.column("_text").to_pylist()]
                columns = [batch.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays(columns + _outputs(texts, outputs), names=out.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                row, text = batch.column("_row")[0].as_py(), batch.column("_text")[0].as_py()
                at = 0
                while at < len(text):
                    end = safe(text, min(at + spread, len(text)), len(text), 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int64()), pa.array([at], pa.int32()), pa.array([text[at:end]], pa.string())],
                        names=["_row", "_at", "_text"],
                    )
                    at = end

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, leaf)
        for whole in batches:
            for batch in _slices(whole, 1):
                text = batch.column("_text")[0].as_py()
                piece = own.tree(text, 0, len(text))
                yield pa.RecordBatch.from_pydict(
                    {
                        "_row": batch.column("_row"), "_at": batch.column("_at"), "_text": batch.column("_text"),
                        "starts": pa.array([piece.starts], pa.list_(pa.int32())), "ends": pa.array([piece.ends], pa.list_(pa.int32())),
                        "ids": pa.array([[e[0] for e in piece.entries]], pa.list_(pa.string())),
                        "tokens": pa.array([[e[1] for e in piece.entries]], pa.list_(pa.string())),
                    }
                )

    def joined(key, table):
        own = encoder(path, leaf)
        table = table.sort_by("_at")
        text = "".join(table.column("_text").to_pylist())
        parts = []
        for at, s, e, i, k in zip(*(table.column(c).to_pylist() for c in ("_at", "starts", "ends", "ids", "tokens"))):
            entries = [(x, y, x.count(" ") + 1 if x else 0) for x, y in zip(i, k)]
            parts.append((at, Piece([at + x for x in s], [at + x for x in e], entries)))
        bounds = [p[0] for p in parts] + [len(text)]
        pieces = [p[1] for p in parts]
        while len(pieces) > 1:
            pairs = range(0, len(pieces) - 1, 2)
            up = [own.join(text, pieces[j], pieces[j + 1], bounds[j], bounds[j + 1], bounds[j + 2]) for j in pairs]
            odd = len(pieces) % 2
            bounds = bounds[: len(pieces) - odd : 2] + ([bounds[-2]] if odd else []) + [bounds[-1]]
            pieces = up + (pieces[-1:] if odd else [])
        columns = [pa.array([key[0].as_py()], pa.int64())] + _outputs([pieces[0].entries], outputs)
        return pa.Table.from_arrays(columns, names=["_row"] + [f.name for f in _fields(outputs)])

    is_long = F.length("_text") > spread
    # Stored, as the number of a row must be the same for its pieces and for the columns kept.
    long = stored(rows.where(is_long).withColumn("_row", F.monotonically_increasing_id()), "long-texts")
    pieces = long.select("_row", "_text").mapInArrow(cut, "_row long, _at int, _text string")
    pieces = pieces.repartition("_row", "_at").mapInArrow(
        leaves, "_row long, _at int, _text string, starts array<int>, ends array<int>, ids array<string>, tokens array<string>"
    )
    whole = pieces.groupBy("_row").applyInArrow(joined, T.StructType([T.StructField("_row", T.LongType())] + _fields(outputs)))
    done = long.drop("_text").join(whole, "_row").drop("_row").select(*out.names)
    return rows.where(~is_long).mapInArrow(short, out).unionByName(done)
