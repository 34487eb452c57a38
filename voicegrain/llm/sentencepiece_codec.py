"""SentencePiece encoding and decoding with a batched numpy Viterbi (operator 7).

The pieces and scores of a model file are used as a unigram lattice: the encoding
is the segmentation of the highest total score.  A piece may begin with a blank or
be a run of blanks, but none goes from a word over the blank behind it or over a
line feed, so each distinct word of a batch, with all blanks before it, is
segmented once.  Words of equal length advance together: hashes of all substrings
of a length probe the sorted keys of the pieces of that length, and for every end
position the best last piece of all words is one vectorised maximum, kept as a
backpointer.  A character that no piece covers becomes its UTF-8 byte pieces.

Works for models of the identity normaliser with a blank put before the text, as
the model in /opt/tokenizers is.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import documents

#: The default model; any path that the driver can read may be given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Line feeds, and words with all blanks before them.
_UNITS = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_CELLS = 150_000
_CHUNK = 3 << 20
_B = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Piece tables: for each length in characters the sorted hashes, their ids and scores; and what each id decodes to."""

    keys: dict[int, np.ndarray]
    ids: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]
    unknown: float
    byte_ids: np.ndarray
    out: list[bytes]


def load(path: str = MODEL) -> Model:
    """Read the tables of a model file (on the driver; a model has tens of thousands of pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    by_length: dict[int, list] = {}
    byte_ids, out = np.zeros(256, np.int64), []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[1:-1], 16)
            byte_ids[value] = i
            out.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            out.append(b"")
        else:
            out.append(piece.replace(BLANK, " ").encode())
            if (BLANK not in piece[1:] or not piece.strip(BLANK)) and "\n" not in piece:
                by_length.setdefault(len(piece), []).append((i, piece, sp.get_score(i)))
    keys, ids, scores = {}, {}, {}
    for n, rows in by_length.items():
        h = _prefixes(_codes([p for _, p, _ in rows], n))[:, n]
        order = np.argsort(h)
        keys[n], ids[n], scores[n] = h[order], np.array([i for i, _, _ in rows])[order], np.array([s for _, _, s in rows], np.float64)[order]
    lowest = min((s.min() for s in scores.values()), default=0.0)
    return Model(keys, ids, scores, lowest - 10, byte_ids, out)


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, (words, length + 1)."""
    h = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        h[:, k + 1] = h[:, k] * _B + tv.mix(codes[:, k].astype(np.uint64) + np.uint64(1))
    return h


def _segment(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of words of one length, in order, and how many each word has; -1 - code point for uncovered ones."""
    n, size = codes.shape
    h = _prefixes(codes)
    lengths = [d for d in sorted(model.keys, reverse=True) if d <= size]  # the longest last piece wins a tie
    score = np.full((len(lengths), size + 1, n), -np.inf)  # by the end of the piece
    token = np.zeros((len(lengths), size + 1, n), np.int64)
    for k, d in enumerate(lengths):
        sub = (h[:, d:] - h[:, :-d] * _B ** np.uint64(d)).T
        at = np.minimum(np.searchsorted(model.keys[d], sub), len(model.keys[d]) - 1)
        hit = model.keys[d][at] == sub
        score[k, d:] = np.where(hit, model.scores[d][at], -np.inf)
        token[k, d:] = model.ids[d][at]
        if d == 1:
            score[k, 1:] = np.where(hit, score[k, 1:], model.unknown)
            token[k, 1:] = np.where(hit, token[k, 1:], -1 - codes.T.astype(np.int64))
    best = np.full((size + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((size + 1, n), np.int64)
    step = np.array(lengths)
    for end in range(1, size + 1):
        usable = step <= end
        total = best[end - step[usable]] + score[usable, end]
        choice = total.argmax(axis=0)
        best[end] = total[choice, np.arange(n)]
        back[end] = choice + (~usable).sum()  # usable ones are the last: lengths fall
    out = np.zeros((n, size), np.int64)
    used = np.zeros(n, np.int64)
    at = np.full(n, size)
    rows = np.arange(n)
    while len(rows):
        k = back[at[rows], rows]
        used[rows] += 1
        out[rows, size - used[rows]] = token[k, at[rows], rows]
        at[rows] -= step[k]
        rows = rows[at[rows] > 0]
    return out[np.arange(size) >= (size - used)[:, None]], used


def segment(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words (blanks already marked), one word after the other, and where each begins (and the last ends)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    used = np.zeros(len(words), np.int64)
    done = []
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        block = max(1, _CELLS // size)
        for lo in range(0, len(at), block):
            part = at[lo : lo + block]
            tokens, count = _bytes_for_uncovered(model, *_segment(model, _codes([words[i] for i in part], size)))
            used[part] = count
            done.append((part, tokens, count))
    begin = np.concatenate([[0], np.cumsum(used)])
    flat = np.zeros(begin[-1], np.int64)
    for part, tokens, count in done:
        flat[_ranges(begin[part], count)] = tokens
    return flat, begin


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of every range, one range after the other."""
    return np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)


def _bytes_for_uncovered(model: Model, tokens: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens below zero (-1 - code point) become the byte pieces of the character in UTF-8."""
    if not len(tokens) or tokens.min() >= 0:
        return tokens, count
    code = np.where(tokens < 0, -1 - tokens, 0)
    n = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    owner = np.repeat(np.repeat(np.arange(len(count)), count), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    tokens, code, n = np.repeat(tokens, n), np.repeat(code, n), np.repeat(n, n)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n] | (code >> (6 * (n - 1)))
    value = np.where(k == 0, lead, 0x80 | ((code >> np.maximum(6 * (n - 1 - k), 0)) & 0x3F))
    return np.where(tokens < 0, model.byte_ids[value], tokens), np.bincount(owner, minlength=len(count))


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes batches of texts; words met before are not segmented again while at most ``limit`` are held."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.flat, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and how many each has; an empty text has none."""
        if len(self.number) > self.limit:
            self.clear()
        known, find, feed = len(self.number), self.number.__getitem__, self.number["\n"]
        rows: list[int] = []
        sizes = []
        for text in texts:
            before = len(rows)
            if "  " in text or text[:1] == " " or BLANK in text:  # more than one blank before a word
                units = _UNITS.findall(" " + text.replace(BLANK, " "))
                rows.extend(find(u[1:] if u[0] == " " else u if u == "\n" else "\n" + u) for u in units)
            elif text:
                lines = text.split("\n")
                rows.extend(map(find, lines[0].split(" ")))
                for line in lines[1:]:
                    first, *rest = line.split(" ")
                    rows.append(feed)
                    if first:
                        rows.append(find("\n" + first))  # no blank stands before it
                    rows.extend(map(find, rest))
            sizes.append(len(rows) - before)
        new = list(self.number)[known:]
        flat, begin = segment(self.model, [w if w == "\n" else w[1:] if w[:1] == "\n" else BLANK + w.replace(" ", BLANK) for w in new])
        self.begin = np.concatenate([self.begin, begin[1:] + self.begin[-1]])
        self.flat = np.concatenate([self.flat, flat])
        at = np.array(rows, dtype=np.int64)
        count = self.begin[at + 1] - self.begin[at]
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0, *sizes])]
        return self.flat[_ranges(self.begin[at], count)], np.diff(ends)


def decode_texts(model: Model, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The texts of token ids that stand one after the other; bytes that are no UTF-8 become U+FFFD."""
    lengths = np.fromiter(map(len, model.out), np.int64, len(model.out))
    table = np.frombuffer(b"".join(model.out), np.uint8)
    size = lengths[ids]
    data = table[_ranges((np.cumsum(lengths) - lengths)[ids], size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [data[a:z].decode("utf-8", "replace").removeprefix(" ") for a, z in zip(ends[:-1], ends[1:])]


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as ``(doc_id, text, ids array<int>)``; a null text counts as empty and has no tokens.

    Every row keeps a row; null ids are kept; an empty table gives no rows; other
    columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(path))
    return documents(docs, id_col, text_col).mapInArrow(_encoding(model), _ENCODED)


def decode(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, and ``ids_sha256``, the digest of the ids as little-endian 32-bit numbers."""
    model = coded.sparkSession.sparkContext.broadcast(load(path))
    return coded.select("doc_id", "text", "ids").mapInArrow(_decoding(model), _DECODED)


def encode_and_decode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one Python worker a task, so that texts and ids go to and fro once."""
    model = docs.sparkSession.sparkContext.broadcast(load(path))
    to_ids, to_text = _encoding(model), _decoding(model)
    return documents(docs, id_col, text_col).mapInArrow(lambda batches: to_text(to_ids(batches)), _DECODED)


_ENCODED = "doc_id long, text string, ids array<int>"
_DECODED = f"{_ENCODED}, decoded string, ids_sha256 string"


def _encoding(model):
    def run(batches):
        encoder = Encoder(model.value)
        for b in batches:
            for lo, hi, _, _ in tv.pieces(b.column(1), _CHUNK):
                ids, sizes = encoder(b.column(1)[lo:hi].to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], ["doc_id", "text", "ids"])
        del encoder
        tv.give_back()

    return run


def _decoding(model):
    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.slice(lo, 1000)
                offsets, flat = part.column(2).offsets.to_numpy(), part.column(2).values.to_numpy()
                digest = [hashlib.sha256(flat[i:j].astype("<i4").tobytes()).hexdigest() for i, j in zip(offsets[:-1], offsets[1:])]
                text = decode_texts(model.value, flat[offsets[0] : offsets[-1]], np.diff(offsets))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string()), pa.array(digest, pa.string())], ["doc_id", "text", "ids", "decoded", "ids_sha256"])

    return run


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Encode and decode every text: ``(doc_id, n_tokens, n_chars, ids_sha256, decoded_sha256, round_trip)``.

    round_trip is false only for texts that hold the blank mark U+2581 itself.
    """
    back = encode_and_decode(docs, path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.char_length("text").cast("long").alias("n_chars"),
        "ids_sha256",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
