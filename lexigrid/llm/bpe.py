"""Byte-pair encoding with forced boundaries.

A merge joins two neighbouring symbols into a vocabulary token, so two bytes that stand side by side in no
token are never joined.  Between such bytes the text is cut with certainty; the fragments are encoded one by
one, and their ids are put one after the other.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from lexigrid.llm.common import short_batches

CACHE_PIECES = 150_000   # distinct pieces whose ids a worker keeps between texts
BATCH_CHARS = 2 << 20    # characters of text whose ids are held at once
# Fixed: the tokenizer's pattern, and the same for lower-cased ASCII
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
_LATIN_PIECES = regex.compile(_PATTERN)
_NOT_PLAIN = re.compile("[^ -~\t-\r]")   # what doesn't stand for its own byte, or isn't ASCII
# Latin letters up to U+024F: composed already, with one lower case in any context, of the same class in every Unicode version
_NOT_LATIN = re.compile("[^ -~\t-\r\xa0-\u024f]")
_MAPPED = "\0"                             # begins a piece whose characters stand for bytes already
_BYTES = ByteLevel(add_prefix_space=False, use_regex=False)  # gives each byte its character


class FragmentEncoder:
    """Encodes whole texts with one tokenizer file (a BPE model with an end-of-word mark)."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        model = parsed["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        vocab = dict(model["vocab"])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.names = {i: t for t, i in vocab.items()}
        self.last = self.tokenizer.model                     # puts the end-of-word mark on a fragment's end
        self.inner = BPE(vocab=vocab, merges=merges)         # for fragments that another one follows
        # a token string is a row of characters, each standing for one byte; pairs with a character of the mark do no harm
        self.joined = {a + b for t in vocab for a, b in zip(t, t[1:])}
        self.special = {t["content"]: t["id"] for t in parsed.get("added_tokens") or []}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        # whether lower-casing and that pattern are all the tokenizer does to printable ASCII
        steps = [n["type"] for n in (parsed.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (parsed.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and splits == [_PATTERN, None]
        self.ids: dict[str, bytes] = {}     # of pieces: ids as 32-bit integers
        self.tokens: dict[str, str] = {}    # of the same pieces: tokens joined by spaces

    def fragments(self, piece: str) -> list[str]:
        """Cut a row of byte characters wherever no token joins the two neighbours."""
        if self.joined.issuperset(map(add, piece, piece[1:])):
            return [piece]
        cuts = [i for i in range(1, len(piece)) if piece[i - 1] + piece[i] not in self.joined]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])]

    def pieces(self, text: str) -> list[str]:
        """What the tokenizer's pattern takes together, in order."""
        if self.plain and not _NOT_PLAIN.search(text):
            return _ASCII_PIECES.findall(text.lower())
        if self.plain and not _NOT_LATIN.search(text):
            return _LATIN_PIECES.findall(text.lower())
        norm = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [_MAPPED + p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm)]

    def learn(self, piece: str) -> None:
        """Encode the fragments of a piece, and remember the outcome."""
        if piece.startswith(_MAPPED):
            row = piece[1:]
        else:
            row = piece if piece.isascii() else _BYTES.pre_tokenize_str(piece)[0][0]
        parts = self.fragments(row)
        ids = [t.id for part in parts[:-1] for t in self.inner.tokenize(part)]
        ids += [t.id for t in self.last.tokenize(parts[-1])]
        self.ids[piece], self.tokens[piece] = array("i", ids).tobytes(), " ".join([self.names[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text as 32-bit integers, and its tokens joined by spaces."""
        ids, tokens = [], []
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                ids.append(array("i", [self.special[part]]).tobytes())
                tokens.append(part)
                continue
            pieces = self.pieces(part)
            new = set(pieces).difference(self.ids)
            if len(self.ids) + len(new) > CACHE_PIECES and self.ids:
                self.ids, self.tokens = {}, {}
                new = set(pieces)
            for p in new:
                self.learn(p)
            ids.append(b"".join(map(self.ids.__getitem__, pieces)))
            tokens.extend(map(self.tokens.__getitem__, pieces))
        return b"".join(ids), " ".join(tokens)


@lru_cache(maxsize=2)
def _encoder(spec: str) -> FragmentEncoder:
    return FragmentEncoder(spec)


def read_spec(path: str) -> str:
    """The tokenizer file's content, read once on the driver; a few MB at most, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, spec: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ids array<int> and decoded string (the tokens joined by spaces) of every whole text.

    The decoded text is that of a tokenizer without decoder, special tokens included.  Null and empty texts give
    no ids and an empty string; further columns are not read; an empty table gives no rows.  Nothing is shuffled.
    """
    keep = ["doc_id"] if keep is None else keep
    short_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>", "decoded string"])

    def run(batches):
        encoder = _encoder(sent.value)
        for batch in batches:
            texts = batch.column(len(keep))
            for start, stop in _spans(texts):
                found = [encoder.encode(t.as_py() or "") for t in texts.slice(start, stop - start)]
                ends = np.cumsum([0, *(len(ids) // 4 for ids, _ in found)])
                values = np.frombuffer(b"".join([ids for ids, _ in found]), np.int32)
                columns = [batch.column(k).slice(start, stop - start) for k in range(len(keep))]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)))
                columns.append(pa.array([tokens for _, tokens in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "decoded"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _spans(texts: pa.Array):
    """Row spans of about BATCH_CHARS characters each."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t.as_py() or "")
        if size >= BATCH_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def digests(encoded: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """n_tokens, and SHA-256 of the decimal ids and of the decoded text."""
    keep = ["doc_id"] if keep is None else keep
    return encoded.select(*keep, F.size("ids").cast("long").alias("n_tokens"), _sha(F.array_join(F.col("ids").cast("array<string>"), " "))
                          .alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def encode_with_file(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    return encode(docs, read_spec(path), text, keep)
