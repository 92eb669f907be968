"""Packing by power-of-two decomposition.

A document's token ids (with one end id) are cut, from the front, into as many pieces of ``max_len`` as fit and then
into pieces of the binary digits of the rest, largest first. Each piece is one sequence: its length is a power of two,
it needs no padding, and no sequence crosses documents. ``bucket`` is the binary logarithm of the length, and ``batch`` groups sequences of one
bucket. Packing has no shuffle: each document is cut where it is read.

Ids are those of the tokenizer for the whole text. With a tokenizer that takes texts apart as ``WORDWISE`` says (checked when it is loaded), distinct words are
encoded once, for blocks of text that end at a blank, however long the text is; with any other each text is encoded at once.

Null text counts as empty (one piece: the end id). Rows with the same or a null id are packed on their own. An empty table gives an empty
result. Other columns aren't read.
"""

from __future__ import annotations

import collections
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.shared import lean
from gapline.llm.textbytes import Block, as_bytes, blocks

BLOCK_BYTES = 2 << 20
#: distinct words whose ids a worker keeps at most
CACHED_WORDS = 600_000
#: blanks: no token of the tokenizer reaches across, whatever stands around them
BREAK = np.ones(256, bool)
BREAK[[0x20, 0x09, 0x0A, 0x0D]] = False
#: between a letter and one of these a token always ends
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:!?#$%&()*+-/=@[]^_{}~"]] = True
#: how the tokenizer takes texts apart for which words can be encoded on their own; fixed values
WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "added": ["<|startoftext|>", "<|endoftext|>"],
}
MARK = b"\x01"
#: lower-case Latin letters only: the tokenizer leaves such a word as it is and in one part
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class CachedEncoder:
    """Ids of texts. If the tokenizer is ``WORDWISE``, it lower-cases and never joins text across blanks, and a distinct word is encoded once."""

    def __init__(self, file: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if file is None:
            import public_tokenizers

            file = public_tokenizers.path("word_bpe_49k.json")
        self.tok = Tokenizer.from_file(file)
        spec = json.loads(self.tok.to_str())
        told = {k: spec[k] for k in ("normalizer", "pre_tokenizer")} | {"added": [x["content"] for x in spec["added_tokens"]]}
        self.wordwise = told == WORDWISE
        self.bare = Tokenizer(self.tok.model)  # without the work that plain words don't need
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        mark = self.tok.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit numbers."""
        if len(self.young) > CACHED_WORDS // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = [young.get(w) for w in words]
        new = []
        for k, v in enumerate(out):
            if v is None:
                if (v := old.get(words[k])) is None:
                    new.append(k)
                else:
                    out[k] = young[words[k]] = v
        for k, ids in zip(new, self.encode([words[k] for k in new]), strict=True):
            out[k] = young[words[k]] = ids
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Many words in one call; plain ones go to the model alone, and words that hold the mark are encoded on their own."""
        if self.mark is None:
            return [self.alone(w) for w in words]
        plain = [PLAIN.fullmatch(w) is not None for w in words]
        other = [w for w, x in zip(words, plain, strict=True) if not x]
        marked = [w for w in other if MARK in w]
        known = dict(zip(marked, map(self.alone, marked), strict=True))
        other = [w for w in other if w not in known]
        known.update(zip(other, self.joined(self.tok, other), strict=True))
        got = iter(self.joined(self.bare, list(compress(words, plain))))
        return [next(got) if x else known[w] for w, x in zip(words, plain, strict=True)]

    def alone(self, word: bytes) -> bytes:
        return np.array(self.tok.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def joined(self, tok, words: list[bytes]) -> list[bytes]:
        """One call for many words, with a mark of one id between them."""
        got: list[bytes] = []
        for k in range(0, len(words), 2000):
            text = (b" " + MARK + b" ").join(words[k : k + 2000]).decode("utf-8", "replace")
            ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            raw, a = ids.tobytes(), 0
            for z in (ends * 4).tolist():
                got.append(raw[a:z])
                a = z + 4
        return got

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end among them."""
        if not self.wordwise:
            found = [
                np.array(e.ids, "<u4")
                for e in self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            ]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum([0, *map(len, found)])
        if len(texts) == 1 and len(texts[0]) > 2 * BLOCK_BYTES:
            found = [self.by_words([x])[0] for x in at_blanks(texts[0], BLOCK_BYTES)]
            return np.concatenate(found), np.array([0, sum(map(len, found))])
        return self.by_words(texts)

    def by_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        b = Block(texts)
        buf = b.buf
        inside = BREAK[buf]
        inside[-1] = False
        inside[b.begin[1:] - 1] = False
        letter = LETTER[buf]
        letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        cut = inside.copy()  # where a word begins
        cut[1:] &= ~inside[:-1] | (STOP[buf[1:]] & letter[:-1])
        starts = np.flatnonzero(cut)
        kept = np.cumsum(inside, dtype=np.int32)
        offsets = np.append(kept[starts] - 1, kept[-1]).astype(np.int32)
        data = buf[inside] if any(b"|>" in t for t in texts) else FOLD[buf[inside]]  # special tokens are told by their case
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        each = self.look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())  # a tenth of to_pylist's time
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        at = np.cumsum(size) - size
        n = size[code]
        before = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        ids = np.frombuffer(b"".join(each), "<u4")[np.repeat(at[code] - before[:-1], n) + np.arange(before[-1])]
        return ids, before[np.append(np.searchsorted(starts, b.begin), len(starts))]


_loaded: dict[str | None, CachedEncoder] = {}


def encoder_of(tokenizer_file: str | None) -> CachedEncoder:
    """A worker's tokenizer with the words that it knows from earlier batches and tasks; one is held at a time."""
    if tokenizer_file not in _loaded:
        _loaded.clear()
        _loaded[tokenizer_file] = CachedEncoder(tokenizer_file)
    return _loaded[tokenizer_file]


def at_blanks(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of a text that end at blanks, of at most ``most`` bytes where words allow that."""
    a = 0
    while len(text) - a > most:
        z = max(text.rfind(c, a, a + most) for c in (b" ", b"\n", b"\t", b"\r")) + 1
        if z <= a:
            z = min((k for k in (text.find(c, a + most) for c in (b" ", b"\n", b"\t", b"\r")) if k >= 0), default=len(text))
        yield text[a:z]
        a = z
    yield text[a:]


def pieces(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of n ids: powers of two, not rising."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary, batch string"


def pack(
    docs: DataFrame,
    tokenizer_file: str | None = None,
    max_len: int = 2048,
    end_id: int = 1,
    with_ids: bool = True,
    batch_tokens: int = 1 << 15,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, ids (little-endian unsigned 32-bit; null
    unless ``with_ids``), batch, sequence_id, offset. ``max_len`` is a power of two. ``tokenizer_file`` is a path on each
    executor; by default the public word-level BPE.

    A batch holds sequences of one bucket, and so of one length: ``batch_tokens`` ids (one sequence at least). It is filled from one
    part of the input, so no bucket is shuffled or gathered; the last batch of each bucket and part may be smaller. Its name is bucket, part and number."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    if batch_tokens < 1:
        raise ValueError("batch_tokens must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(tokenizer_file)
        part, made = TaskContext.get().partitionId(), collections.Counter()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for i, j in blocks(texts, BLOCK_BYTES):
                ids, at = enc.ids(texts[i:j])
                rows: list[tuple] = []
                for d in range(i, j):
                    own = np.append(ids[at[d - i] : at[d - i + 1]], np.uint32(end_id)).astype("<u4")
                    start = 0
                    for size in pieces(len(own), max_len):
                        raw = own[start : start + size].tobytes()
                        bucket = size.bit_length() - 1
                        name = f"{bucket}-{part}-{made[bucket] // max(1, batch_tokens >> bucket)}"
                        made[bucket] += 1
                        rows.append((doc_ids[d], start, size, zlib.crc32(raw), len(own), bucket, raw if with_ids else None, name))
                        start += size
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.string()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids", "batch"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    out = docs.select("doc_id", "text").mapInArrow(lean(run), SCHEMA)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
