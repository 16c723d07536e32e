"""Byte-level BPE: encode whole texts with the ``tokenizers`` library over Arrow batches, and decode the ids again.

The rank file is turned into a ``tokenizers`` model: every token becomes a string through the byte-to-character mapping
(each byte has a printable character of its own), and every split of a token into two tokens becomes a merge at that
token's rank, which is the rule by which rank files merge. Decoding reverses the byte table; a character whose bytes lie
in two tokens is whole again once the bytes are joined.

A text is cut into chunks at white space first. No match of the pattern crosses such a cut, so ids of a chunk don't depend
on its neighbours and those of the chunks seen most lately are kept, up to a fixed number.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import fresh

#: Chunks of which a worker keeps the ids; longer ones are not kept. Characters and new chunks that are worked on at once.
CACHE_CHUNKS, LONG_CHUNK, AT_ONCE_CHARS, JOINED = 150_000, 256, 1_000_000, 500
_CHUNK = regex.compile(r" ?\S+|\s+(?!\S)|\s+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, letters = read_ranks(path), byte_characters()
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        shown = {token: "".join(letters[b] for b in token) for token in ranks}
        merges = [(shown[token[:i]], shown[token[i:]]) for token in self.tokens for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        model = models.BPE(vocab={shown[token]: rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.line_break = ranks[b"\n"]
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, start, size = [], 0, 0
        for i, text in enumerate(texts, 1):
            size += len(text)
            if size >= AT_ONCE_CHARS or i == len(texts):
                out += self._encode(texts[start:i])
                start, size = i, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        chunks = [_CHUNK.findall(text) for text in texts]
        used = set().union(*chunks)
        new = [c for c in used if c not in self.cache]
        if len(self.cache) + len(new) > CACHE_CHUNKS:
            self.cache = {c: self.cache[c] for c in used if c in self.cache}
        self._learn(new)
        out = [b"".join(map(self.cache.__getitem__, c)) for c in chunks]
        for c in new:
            if len(c) > LONG_CHUNK:
                del self.cache[c]
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks. Many are encoded as one text, with a line break after each, and cut apart at its token."""
        alone = [c for c in chunks if c.isspace() or len(c) > LONG_CHUNK]
        self.cache.update((c, np.array(x.ids, dtype="<u4").tobytes()) for c, x in zip(alone, self.tokenizer.encode_batch(alone, add_special_tokens=False), strict=True))
        rest = [c for c in chunks if not (c.isspace() or len(c) > LONG_CHUNK)]
        for i in range(0, len(rest), JOINED):
            part = rest[i : i + JOINED]
            ids = np.array(self.tokenizer.encode("\n".join(part) + "\n", add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.line_break)
            data, starts = ids.tobytes(), np.concatenate([[0], ends[:-1] + 1])
            self.cache.update((c, data[4 * a : 4 * b]) for c, a, b in zip(part, starts.tolist(), ends.tolist(), strict=True))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> list[tuple[int, int]]:
        """Character range of each token. A token that holds part of a character's bytes spans that whole character."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        ends = np.cumsum([len(self.tokens[i]) for i in np.frombuffer(ids, dtype="<u4")], dtype=np.int64)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return [(int(char_of[a]), int(char_of[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]


@functools.lru_cache(maxsize=2)
def _coder(path: str) -> ByteBPE:
    return ByteBPE(path)


def _as_strings(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def bpe_encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a binary column ``ids`` (little-endian unsigned 32-bit) of each whole text.

    With ``decoded``, a binary column of that name too: what the ids decode to, made in the same pass.

    Null and empty texts have no ids (an empty value). An input column of the same name is replaced. Rows are encoded one
    by one: repeated rows give repeated results, an empty table an empty one. ``path`` must lie on every node, as an
    installed package's file does.
    """
    made = [n for n in (ids, decoded) if n]
    source = docs.drop(*[c for c in docs.columns if c != text and c.lower() in {n.lower() for n in made}])
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for part in tk.pieces(batch, names.index(text)):
                found = coder.encode(_as_strings(part.column(names.index(text))))
                columns = {c: part.column(i) for i, c in enumerate(names)} | {ids: pa.array(found, type=pa.binary())}
                if decoded:
                    columns[decoded] = pa.array([coder.decode(x) for x in found], type=pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields] + [f"`{n}` binary" for n in made]
    return source.mapInArrow(run, ", ".join(fields))


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the bytes of the tokens, joined. Null ids decode to null."""
    source = encoded.drop(*[c for c in encoded.columns if c.lower() == decoded.lower()])
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for part in tk.pieces(batch, names.index(ids)):
                found = [None if x is None else coder.decode(x) for x in part.column(names.index(ids)).to_pylist()]
                columns = {c: part.column(i) for i, c in enumerate(names)}
                yield pa.RecordBatch.from_pydict(columns | {decoded: pa.array(found, type=pa.binary())})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields] + [f"`{decoded}` binary"]
    return source.mapInArrow(run, ", ".join(fields))


def bpe_spans(encoded: DataFrame, path: str, text: str = "text", ids: str = "ids", spans: str = "spans") -> DataFrame:
    """``encoded`` with the character range of each token, as an array of structs."""
    name = fresh(encoded, spans)

    @F.udf("array<struct<start:int,end:int>>", useArrow=True)
    def ranges(value, held):
        return _coder(path).offsets(value or "", bytes(held or b""))

    return encoded.withColumn(name, ranges(F.col(text), F.col(ids)))


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, and digests of the ids and of the decoded bytes, a row for each row of ``docs``."""
    both = bpe_encode(docs.select("doc_id", F.col(text).alias("text")), path, decoded="decoded")
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and digests of the ids and of what they decode to. A null text is empty: no tokens."""
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path())
