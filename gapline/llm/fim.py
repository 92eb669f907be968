"""Fill-in-the-middle by a parallel scan with an automaton.

A text is read by a finite automaton over bytes (:class:`Automaton`) that counts the units of the text (here lines), its characters and the
control strings in it. A chunk of a text, whose entry state isn't known, is read from all states at once: it gives the function from entry to
exit state, and what is counted for each entry state. Such pairs are composed, which is associative, so that chunks are read in any
order and anywhere; composing those before a chunk resolves its entry state and the units before it. The chunk in which a cut lies is read
once more from its entry state, up to the cut.

This is done on two levels. In a task all texts of a batch are cut in lanes of ``LANE`` bytes, which numpy reads side by side, and the lanes of
each text are composed in doubling steps. A text of more than ``chunk_bytes`` bytes is first cut in chunks of so many bytes, which are dealt to
all tasks; their functions (a few numbers each) meet by text and are composed there, the cuts go to the chunks that hold them, and
the places found go back to the row. Both give the same cuts; no text is read by one task alone unless it is one chunk.

Cuts: of n units the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1), the middle after the larger; h1 to h4 are
the first 8-digit groups of the hex SHA-256 of ``seed:id``. With h3 % 100 >= ``rate``, no text, or a control string in it, the text stays
plain; with h4 % 100 < ``spm`` the suffix comes first.

Null text counts as empty (plain); a null id counts as an empty string in the hash. Rows with the same id get the same draws, each on
its own text; repeated rows give repeated results; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.shared import lean, materialise
from gapline.llm.textbytes import as_bytes, blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LANE = 64
BLOCK_BYTES = 2 << 20


class Automaton:
    """Units are lines: a byte read at the start of a line begins one. A state is (at the start of a line, bytes of a control string seen).

    ``goto[state, class]`` is the next state, ``begins`` is 1 where a unit begins, ``marks`` where a control string ends."""

    NEWLINE, OPEN, NAME, CLOSE, OTHER, PAD = range(6)
    STATES, CLASSES, START = 6, 8, 0

    def __init__(self) -> None:
        self.classes = np.full(256, self.OTHER, np.uint8)
        for c, kind in (("\n", self.NEWLINE), ("<", self.OPEN), (">", self.CLOSE), ("P", self.NAME), ("S", self.NAME), ("M", self.NAME)):
            self.classes[ord(c)] = kind
        self.goto = np.zeros((self.STATES, self.CLASSES), np.uint8)
        self.begins, self.marks = np.zeros_like(self.goto), np.zeros_like(self.goto)
        for inside in range(2):
            for seen in range(3):
                s = 3 * inside + seen
                for c in range(5):
                    after = 1 if c == self.OPEN else 2 if c == self.NAME and seen == 1 else 0
                    self.goto[s, c] = 3 * (c != self.NEWLINE) + after
                    self.begins[s, c] = not inside
                    self.marks[s, c] = c == self.CLOSE and seen == 2
                self.goto[s, self.PAD] = s  # changes and counts nothing

    def lanes(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte classes of the lanes of each text, one column a lane; the first lane of each text, and all lanes' number; where lanes begin in buf."""
        per = -(-lengths // LANE)
        first = np.concatenate([[0], np.cumsum(per)])
        text = np.repeat(np.arange(len(per)), per)
        begin = starts[text] + (np.arange(first[-1]) - first[text]) * LANE
        end = (starts + lengths)[text]
        at = begin + np.arange(LANE)[:, None]
        cls = self.classes[buf[np.minimum(at, len(buf) - 1)]]
        cls[at >= end] = self.PAD
        return cls, first, begin

    def read(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each lane and entry state: exit state, units begun, control strings."""
        n = cls.shape[1]
        state = np.repeat(np.arange(self.STATES, dtype=np.uint8), n).reshape(self.STATES, n)
        units, marks = np.zeros((self.STATES, n), np.uint8), np.zeros((self.STATES, n), np.uint8)
        goto, begins, ends = self.goto.ravel(), self.begins.ravel(), self.marks.ravel()
        for row in cls:
            k = state * np.uint8(self.CLASSES) + row
            units += begins[k]
            marks += ends[k]
            state = goto[k]
        return state, units.astype(np.int64), marks.astype(np.int64)

    def place(self, cls: np.ndarray, state: np.ndarray, count: np.ndarray) -> np.ndarray:
        """For each lane, read from ``state``: the byte that begins its ``count``-th unit."""
        at, left = np.full(cls.shape[1], cls.shape[0], np.int64), count.astype(np.int64)
        for t, row in enumerate(cls):
            left = left - self.begins[state, row]
            at = np.where((left == 0) & (at == cls.shape[0]), t, at)
            state = self.goto[state, row]
        return at


def compose(f: tuple[np.ndarray, ...], g: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """First f, then g; arrays of (state, lane): the exit state, then counts."""
    go = f[0].astype(np.int64)
    return (np.take_along_axis(g[0], go, 0), *(a + np.take_along_axis(b, go, 0) for a, b in zip(f[1:], g[1:], strict=True)))


def prefixes(f: tuple[np.ndarray, ...], first: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each lane the composition of all lanes of its text up to and with it, in doubling steps."""
    n = f[0].shape[1]
    own = np.arange(n) - np.repeat(first[:-1], np.diff(first))  # lanes before it in its text
    step = 1
    while n and step <= own.max():
        at = np.flatnonzero(own >= step)
        new = compose(tuple(x[:, at - step] for x in f), tuple(x[:, at] for x in f))
        f = tuple(x.copy() for x in f)
        for x, y in zip(f, new, strict=True):
            x[:, at] = y
        step *= 2
    return f


AUTOMATON = Automaton()


class Scan:
    """Some texts in one buffer, their lanes, and for each lane and entry state of its text the exit state and counts so far."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.buf = np.frombuffer(b"".join(texts) + b" ", np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.cls, self.first, self.begin = AUTOMATON.lanes(self.buf, self.starts, self.lengths)
        self.up_to = prefixes(AUTOMATON.read(self.cls), self.first)

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state, text): exit state, units and control strings of each whole text."""
        same = np.repeat(np.arange(AUTOMATON.STATES)[:, None], len(self.lengths), 1)
        out = [same, np.zeros_like(same), np.zeros_like(same)]
        some = np.flatnonzero(self.lengths)
        for x, y in zip(out, self.up_to, strict=True):
            x[:, some] = y[:, self.first[1:][some] - 1]
        return tuple(out)

    def cut(self, text: np.ndarray, state: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Byte (from the text's start) after ``units`` units of each ``text``, entered in ``state``; all bytes, if there are no more units."""
        have = self.totals()[1][state, text]
        out = np.where(units < have, -1, self.lengths[text])
        at = np.flatnonzero(out < 0)
        if not len(at):
            return out
        text, state, want = text[at], state[at], units[at] + 1  # the cut is where the next unit begins
        lo, hi = self.first[text], self.first[text + 1] - 1
        while (lo < hi).any():  # the first lane with so many units
            mid = (lo + hi) // 2
            enough = self.up_to[1][state, mid] >= want
            lo, hi = np.where(enough, lo, mid + 1), np.where(enough, mid, hi)
        head = lo == self.first[text]
        entry = np.where(head, state, self.up_to[0][state, lo - 1])
        before = np.where(head, 0, self.up_to[1][state, lo - 1])
        place = AUTOMATON.place(self.cls[:, lo], entry, want - before)
        out[at] = self.begin[lo] + place - self.starts[text]
        return out


def draws(id_column: Column, seed: str) -> list[Column]:
    """h1 to h4 of a row."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def targets(n: np.ndarray, h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def characters(part: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(part, np.uint8) & 0xC0 != 0x80))


def form(text: bytes, marked: bool, h3: int, h4: int, rate: int, spm: int) -> str:
    return "plain" if not text or marked or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"


def formatted(text: bytes, kind: str, a: int, z: int) -> tuple[bytes, int | None, int | None]:
    """The output and the characters of prefix and middle."""
    if kind == "plain":
        return text, None, None
    p, m, s = text[:a], text[a:z], text[z:]
    order = [(PREFIX, p), (SUFFIX, s), (MIDDLE, m)] if kind == "psm" else [(SUFFIX, s), (PREFIX, p), (MIDDLE, m)]
    return b"".join(mark.encode() + part for mark, part in order), characters(p), characters(m)


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
HASHES = ("h1", "h2", "h3", "h4")


def _whole(docs: DataFrame, rate: int, spm: int) -> DataFrame:
    """Texts of one chunk each: doc_id, text, h1 to h4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            h = [b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            for i, j in blocks(texts, BLOCK_BYTES):
                some, hs = texts[i:j], [x[i:j] for x in h]
                scan = Scan(some)
                _, units, marks = (x[AUTOMATON.START] for x in scan.totals())
                who, state = np.arange(j - i), np.zeros(j - i, np.int64)
                a, z = (scan.cut(who, state, t) for t in targets(units, hs))
                kinds = [form(t, bool(m), int(x), int(y), rate, spm) for t, m, x, y in zip(some, marks, hs[2], hs[3], strict=True)]
                yield _rows(b.column(0)[i:j], units, kinds, [formatted(*x) for x in zip(some, kinds, a.tolist(), z.tolist(), strict=True)])

    return docs.select("doc_id", "text", *HASHES).mapInArrow(lean(run), SCHEMA)


def _rows(ids: pa.Array, units, kinds: list[str], made: list[tuple[bytes, int | None, int | None]]) -> pa.RecordBatch:
    out = pa.array([x[0] for x in made], pa.binary()).cast(pa.string())
    rest = [pa.array(units, pa.int64()), pa.array(kinds, pa.string()), *(pa.array([x[k] for x in made], pa.int64()) for k in (1, 2))]
    return pa.RecordBatch.from_arrays([ids, *rest, out], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _functions(chunks: DataFrame) -> DataFrame:
    """of, chunk -> its exit states, units and control strings for each entry state, and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(2))
            for i, j in blocks(texts, BLOCK_BYTES):
                f = Scan(texts[i:j]).totals()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], *(pa.array(x.T.tolist(), pa.list_(pa.int64())) for x in f)],
                    names=["of", "chunk", "goto", "units", "marks"],
                )

    kind = "of long, chunk int, goto array<long>, units array<long>, marks array<long>"
    return chunks.select("of", "chunk", "part").mapInArrow(lean(run), kind)


def _resolved(functions: DataFrame, docs: DataFrame) -> DataFrame:
    """For each long text: n, whether it is marked, and for each of its two cuts the chunk that holds it, the chunk's entry state and the
    units of the chunk before the cut (chunk -1: the cut is the text's end)."""
    gathered = functions.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("chunk", "goto", "units", "marks"))).alias("f"))
    gathered = gathered.join(docs.select("of", *HASHES), "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                f = tuple(np.array([c[k] for c in r["f"]], np.int64).T for k in ("goto", "units", "marks"))
                up_to = prefixes(f, np.array([0, len(r["f"])]))
                exits, units, marks = (x[AUTOMATON.START] for x in up_to)
                n = int(units[-1])
                a, z = (int(x) for x in targets(np.int64(n), [np.int64(r["h1"]), np.int64(r["h2"])]))
                cuts = []
                for which, want in enumerate((a, z)):
                    k = int(np.searchsorted(units, want + 1)) if want < n else -1
                    before, entry = (int(units[k - 1]), int(exits[k - 1])) if k > 0 else (0, AUTOMATON.START)
                    cuts.append({"which": which, "chunk": k, "entry": entry, "skip": want - before})
                rows.append({"of": r["of"], "n": n, "marked": bool(marks[-1]), "cuts": cuts})
            kind = pa.schema(
                [
                    ("of", b.schema.field("of").type),
                    ("n", pa.int64()),
                    ("marked", pa.bool_()),
                    ("cuts", pa.list_(pa.struct([("which", pa.int32()), ("chunk", pa.int32()), ("entry", pa.int32()), ("skip", pa.int64())]))),
                ]
            )
            yield pa.RecordBatch.from_pylist(rows, kind)

    kind = "array<struct<which: int, chunk: int, entry: int, skip: long>>"
    return gathered.mapInArrow(lean(run), f"of long, n long, marked boolean, cuts {kind}")


def _places(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """of, which, chunk -> bytes of the chunk before the cut."""
    both = chunks.join(wanted, ["of", "chunk"]).select("of", "which", "chunk", "part", "entry", "skip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(3))
            for i, j in blocks(texts, BLOCK_BYTES):
                entry, skip = (b.column(k)[i:j].to_numpy(zero_copy_only=False).astype(np.int64) for k in (4, 5))
                at = Scan(texts[i:j]).cut(np.arange(j - i), entry, skip)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], b.column(2)[i:j], pa.array(at, pa.int64())],
                    names=["of", "which", "chunk", "bytes"],
                )

    return both.mapInArrow(lean(run), "of long, which int, chunk int, bytes long")


def _long(docs: DataFrame, chunk_bytes: int, rate: int, spm: int) -> DataFrame:
    """Texts of several chunks. They are written with a number for each row, which knows a text while it is apart."""
    docs = materialise(docs.withColumn("of", F.monotonically_increasing_id()), "long-texts")
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk_bytes).cast("int"))
    chunks = docs.select("of", F.col("text").cast("binary").alias("raw"), F.explode(starts).alias("chunk")).select(
        "of", "chunk", F.substring("raw", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("part")
    )
    chunks = chunks.repartition("of", "chunk")
    resolved = materialise(_resolved(_functions(chunks), docs), "cuts")
    each = resolved.select("of", F.explode("cuts").alias("c")).select("of", "c.*")
    found = _places(chunks, each.where("chunk >= 0"))
    found = found.groupBy("of").pivot("which", [0, 1]).agg(F.first(F.col("chunk").cast("long") * chunk_bytes + F.col("bytes")))
    cuts = resolved.drop("cuts").join(found.withColumnsRenamed({"0": "a", "1": "z"}), "of", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, made, kinds = [], [], []
            for t, r in zip(as_bytes(b.column(1)), b.drop_columns(["doc_id", "text"]).to_pylist(), strict=True):
                kind = form(t, r["marked"], r["h3"], r["h4"], rate, spm)
                kinds.append(kind)
                units.append(r["n"])
                made.append(formatted(t, kind, *(len(t) if r[k] is None else r[k] for k in "az")))
            yield _rows(b.column(0), units, kinds, made)

    return docs.join(cuts, "of").select("doc_id", "text", "h3", "h4", "n", "marked", "a", "z").mapInArrow(lean(run), SCHEMA)


def transform(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: str = "7",
    rate: int = 100,
    spm: int = 50,
    chunk_bytes: int = 1 << 16,
) -> DataFrame:
    """For each row: its id (``doc_id``), ``n`` units, ``form`` (plain, psm, spm), characters of prefix and middle, and the ``output``."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumns(dict(zip(HASHES, draws(F.col("doc_id"), seed), strict=True)))
    several = F.octet_length("text") > chunk_bytes
    return _whole(rows.where(~several), rate, spm).unionByName(_long(rows.where(several), chunk_bytes, rate, spm))


def restore(output: Column, kind: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm, spm = (F.concat(*(F.get(part, F.lit(k)) for k in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(output)
