"""Media columns: payloads in tar shards, addressed by content.

Each input partition writes one tar shard to the shared folder. A payload is stored as a grayscale PNG (8-bit samples, fixed
width); its tar member is named by the SHA-256 of the stored form, and a form that the shard holds already is not written
again. Rows carry digest, shard, offset and length. Metadata columns (width, height, depth, colour) come from range reads
of the header bytes only; decoding reads the member's own range. A shard's name holds the task attempt, so a repeated or
speculative attempt never touches a shard that rows point to.

Null text is an empty payload (one block of blanks). Rows are independent; equal texts give equal forms and features, repeated rows repeated ones. An
empty table gives an empty result and no shard. A text of any length is one payload, held by its task. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.shared import fresh_path, lean, materialise
from gapline.llm.textbytes import as_bytes

UNIT = 192
KNOWN = 200_000  # payloads of a shard that a task remembers at most
#: signature, then length and type of the first chunk of a PNG
HEAD = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR"
HEADER_BYTES = 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = UNIT) -> bytes:
    """``payload``, a positive multiple of ``width`` bytes, as gray samples; the same bytes always give the same form."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    return HEAD[:8] + _chunk(
        b"IHDR",
        struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0),
    ) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first 33 bytes."""
    if head[:16] != HEAD:
        raise ValueError("not a PNG of this store")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(form: bytes) -> bytes:
    """The samples of a form of :func:`encode_png`; checks the chunks' sums."""
    width = read_header(form)[0]
    at, data = 8, b""
    while at < len(form):
        (n,) = struct.unpack(">I", form[at : at + 4])
        kind, body = form[at + 4 : at + 8], form[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", form[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (UNIT if not text else 0))


def features(payload: bytes, bins: int = 8) -> str:
    """Mean and deviation of the samples, and shares of ``bins`` equal ranges, in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x >> 5, minlength=bins)[:bins] * 1000 // len(x)
    mean = int(x.sum(dtype=np.int64)) * 1000 // len(x)
    square = int((x.astype(np.int64) ** 2).sum()) * 1000 // len(x)
    return f"m{mean}-s{square}-" + ".".join(map(str, share))


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def store(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the texts of ``docs`` (doc_id, text) into shards under ``folder`` and returns the written index."""
    folder = folder or fresh_path(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        name = f"shard-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tar"
        places: dict[bytes, tuple[str, int, int]] = {}  # of the payloads in this shard, by their digest
        out = None
        try:
            at = 0
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                    payload = payload_of(text)
                    key = hashlib.sha256(payload).digest()
                    if key not in places:
                        out = out or fs.open_output_stream(f"{base}/{name}")
                        form = encode_png(payload)
                        digest = hashlib.sha256(form).hexdigest()
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(form)
                        header = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(header + form + b"\0" * (-len(form) % 512))
                        if len(places) >= KNOWN:  # forgetting one only stores it again
                            places.clear()
                        places[key] = (digest, at + len(header), len(form))
                        at += len(header) + len(form) + -len(form) % 512
                    rows.append((doc, len(text), places[key][0], name, *places[key][1:]))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
                    )
            if out:
                out.write(b"\0" * 1024)
        finally:
            if out:
                out.close()

    index = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), INDEX), "media-index")
    return index.withColumn("folder", F.lit(folder))


META = "doc_id long, n_bytes long, digest string, folder string, shard string, offset long, length long, width int, height int, depth int, colour int"


def _by_shard(index: DataFrame) -> DataFrame:
    """Rows near each other in a shard stay together: a row's range is read once though many rows point to it."""
    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return index.repartition(n, "shard", F.floor(F.col("offset") / (1 << 22))).sortWithinPartitions("shard", "offset")


def with_metadata(index: DataFrame) -> DataFrame:
    """Adds width, height, depth and colour, from reads of the header bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file, head = ("", "", -1), None, (0, 0, 0, 0)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                place = (r["folder"], r["shard"], r["offset"])
                if place != last:
                    if place[:2] != last[:2]:
                        fs, base = _open(r["folder"])
                        file = fs.open_input_file(f"{base}/{r['shard']}")
                    head, last = read_header(file.read_at(HEADER_BYTES, r["offset"])), place
                rows.append(r | dict(zip(("width", "height", "depth", "colour"), head, strict=True)))
            yield pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema([*b.schema, *((c, pa.int32()) for c in ("width", "height", "depth", "colour"))]),
            )

    cols = ["doc_id", "n_bytes", "digest", "folder", "shard", "offset", "length"]
    return _by_shard(index.select(*cols)).mapInArrow(lean(run), META)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
EXTRA = ("depth", "colour")


def read_back(index: DataFrame) -> DataFrame:
    """Reads each row's range, checks it against its digest, decodes it and computes the features. An index of :func:`with_metadata` keeps
    its columns, which are checked against the payload."""
    meta = [c for c in ("width", "height", *EXTRA) if c in index.columns]
    extra = [c for c in EXTRA if c in meta]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file, got, head = ("", "", -1), None, (), {}
        for b in batches:
            rows = []
            for r in b.to_pylist():
                place = (r["folder"], r["shard"], r["offset"])
                if place != last:
                    if place[:2] != last[:2]:
                        fs, base = _open(r["folder"])
                        file = fs.open_input_file(f"{base}/{r['shard']}")
                    form = file.read_at(r["length"], r["offset"])
                    sha = hashlib.sha256(form).hexdigest()
                    if sha != r["digest"]:
                        raise ValueError(f"{r['shard']} at {r['offset']}: the stored bytes differ from their digest")
                    payload, last = decode_png(form), place
                    head = dict(zip(("width", "height", *EXTRA), read_header(form), strict=True))
                    got = (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(form),
                        sha,
                        features(payload),
                        *(head[c] for c in ("width", "height", *extra)),
                    )
                if any(r[c] != head[c] for c in meta):
                    raise ValueError(f"{r['shard']} at {r['offset']}: the metadata differ from the payload's")
                rows.append((r["doc_id"], r["n_bytes"], *got))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int32()] * (2 + len(extra))]
                names = [*(f.split()[0] for f in READ.split(", ")), *extra]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    cols = ["doc_id", "n_bytes", "digest", "folder", "shard", "offset", "length", *meta]
    return _by_shard(index.select(*cols)).mapInArrow(lean(run), ", ".join([READ, *(f"{c} int" for c in extra)]))
