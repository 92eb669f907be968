"""A part-of-speech tagger, as the parser of the legality rules: trained on a table, applied to chunks in Arrow batches.

The tagger is a hidden Markov model. :func:`train` counts, over a table of tagged words, how often each word, each ending (its last three letters) and
each step from tag to tag occurs: sums of one aggregation. The counts of the ``kept`` most frequent words stay; other words are judged by their endings,
of which there are few. That bounds the model (:func:`save` writes it as a table, :func:`load` reads it), whatever the table's size.

:func:`tag` finds each chunk's most probable tags (Viterbi) with costs in whole thousandths of the logarithm, so that results don't depend on the order of
sums; of equals the first tag by name wins. The chunks of a batch are stepped through side by side with numpy, in time proportional to their words. Each
Python worker loads the model once. :func:`parse` adds shallow structure: dependencies by the tags of neighbours, noun chunks as runs
of tags, sentences by their marks. :func:`with_parser` does all of it, and the alignment with the text's own tokens, where a chunk's tokens are: nothing
is joined.

Where no model can be loaded (:func:`legality`) a warning is given and the word rules hold alone. Chunks without tokens have no parse; words are never
null, since tokens aren't.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline import config as C
from gapline.functions import text as T
from gapline.functions.lists import cuts, firsts_of, kinds_of, lists_of, sizes_of
from gapline.operators import gaps

#: words whose own counts are kept; a model has at most so many words, as many endings and the tags' steps
KEPT = 50_000
#: words of the chunks that a worker takes apart at once
WORDS = 20_000
#: added to each count
ADDED = 0.1
START = "<s>"
#: a parser's tokens: words, what follows an apostrophe, marks
TOKEN = r"[A-Za-z0-9]+|['’][A-Za-z0-9]*|[^\sA-Za-z0-9]"
# fixed values: tags of noun chunks, and of the heads of modifiers
NOMINAL = ("DET", "ADJ", "NUM", "NOUN", "PROPN")
NOUNS = ("NOUN", "PROPN")
# end of fixed values


class NoTagger(LookupError):
    """The model can't be loaded."""


def taken_apart(tokens: Column) -> Column:
    """The parser's tokens of the text that ``tokens`` give."""
    return F.regexp_extract_all(T.detokenize(tokens), F.lit(f"({TOKEN})"), F.lit(1))


def words(chunked: DataFrame) -> DataFrame:
    """The parser's tokens (words) of each chunk's text."""
    return chunked.select(*gaps.CHUNK, taken_apart(F.col("tokens")).alias("words"))


def ending(word: Column) -> Column:
    return F.right(word, F.lit(3))


def train(tagged: DataFrame, kept: int = KEPT) -> DataFrame:
    """The model of ``tagged`` (a column tagged: array of struct<text, tag>, in order): kind (word, ending, step), key, tag, n. Rows without tags don't
    count; words are compared in lower case."""
    rows = tagged.select(F.filter("tagged", lambda x: x["tag"].isNotNull() & x["text"].isNotNull()).alias("tagged"))
    # each word beside the tag before it: no array is made or searched for a word
    rows = rows.select("tagged", F.concat(F.array(F.lit(START)), F.transform("tagged", lambda x: x["tag"])).alias("step"))
    each = rows.select(F.explode(F.arrays_zip("tagged", "step")).alias("p")).where("p.tagged is not null")
    each = each.select(F.lower("p.tagged.text").alias("word"), "p.tagged.tag", "p.step")
    # the table is read once: all counts are sums of these, which are kept until the model is read (or the catalog's clearCache)
    counts = each.groupBy("word", "tag", "step").agg(F.count(F.lit(1)).alias("n")).persist()
    word = counts.groupBy(F.col("word").alias("key"), "tag").agg(F.sum("n").alias("n"))
    often = word.groupBy("key").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "key").limit(kept).select("key")
    ends = word.groupBy(ending(F.col("key")).alias("key"), "tag").agg(F.sum("n").alias("n"))
    many = ends.groupBy("key").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "key").limit(kept).select("key")
    steps = counts.groupBy(F.col("step").alias("key"), "tag").agg(F.sum("n").alias("n"))
    parts = {"word": word.join(often, "key"), "ending": ends.join(many, "key"), "step": steps}
    named = [t.select(F.lit(k).alias("kind"), "key", "tag", F.col("n").cast("long").alias("n")) for k, t in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def save(model: DataFrame, path: str) -> None:
    model.coalesce(1).write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class Tagger:
    tags: tuple[str, ...]
    words: dict[str, np.ndarray]  # costs by tag
    endings: dict[str, np.ndarray]
    steps: np.ndarray  # from, to; the last row is the start

    def costs(self, word: str) -> np.ndarray:
        low = word.lower()
        found = self.words.get(low)
        if found is None:
            found = self.endings.get(low[-3:])
        return np.zeros(len(self.tags), np.int64) if found is None else found

    def paths(self, kinds: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The tags' numbers of texts of ``sizes`` words that lie one after another; ``ids`` are the words' places in ``kinds``. All texts are stepped
        through together, the longest first."""
        n_tags = len(self.tags)
        own = np.array([self.costs(w) for w in kinds], np.int64).reshape(-1, n_tags)
        order = np.argsort(-sizes, kind="stable")
        begins = (np.cumsum(sizes) - sizes)[order]
        most = int(sizes.max(initial=0))
        going = np.searchsorted(-sizes[order], -np.arange(most)).tolist()  # texts with a word at each place
        to = np.ascontiguousarray(self.steps[:-1].T)
        back = np.zeros((len(ids), n_tags), np.uint8)
        score = np.zeros((going[0] if most else 0, n_tags), np.int64)
        for i, n in enumerate(going):
            at = begins[:n] + i
            if i == 0:
                score[:] = self.steps[-1] + own[ids[at]]
                continue
            ways = score[:n, None, :] + to
            back[at] = come = ways.argmin(2)
            score[:n] = np.take_along_axis(ways, come[:, :, None], 2)[:, :, 0] + own[ids[at]]
        here, out = score.argmin(1), np.zeros(len(ids), np.int64)
        for i in range(most - 1, -1, -1):
            n = going[i]
            at = begins[:n] + i
            out[at] = here[:n]
            here[:n] = back[at, here[:n]]
        return out

    def best(self, texts: list[list[str]]) -> list[list[str]]:
        """The tags of each text's words."""
        kinds: dict[str, int] = {}
        ids = [kinds.setdefault(w, len(kinds)) for t in texts for w in t]
        found = iter(self.paths(list(kinds), np.array(ids, np.int64), np.array([len(t) for t in texts], np.int64)).tolist())
        return [[self.tags[next(found)] for _ in t] for t in texts]


def costs(counts: list[int], totals: list[int], kinds: int) -> np.ndarray:
    """-1000 * ln of the smoothed shares, rounded half up."""
    return np.array([math.floor(-1000 * math.log((n + ADDED) / (t + ADDED * kinds)) + 0.5) for n, t in zip(counts, totals, strict=True)], np.int64)


def tagger(model: DataFrame) -> Tagger:
    """The model in memory: at most ``2 * KEPT`` keys by tags, as :func:`train` bounds it."""
    table: dict[str, dict[str, dict[str, int]]] = {"word": {}, "ending": {}, "step": {}}
    for r in model.collect():
        table[r["kind"]].setdefault(r["key"], {})[r["tag"]] = r["n"]
    tags = tuple(sorted({t for row in table["step"].values() for t in row}))
    if not tags or len(tags) > 255:
        raise NoTagger("a model has from 1 to 255 tags")
    total = {t: sum(row.get(t, 0) for row in table["step"].values()) for t in tags}

    def emitted(rows: dict[str, dict[str, int]]) -> dict[str, np.ndarray]:
        return {k: costs([row.get(t, 0) for t in tags], [total[t] for t in tags], len(rows) + 1) for k, row in rows.items()}

    step = [table["step"].get(p, {}) for p in (*tags, START)]
    steps = np.stack([costs([row.get(t, 0) for t in tags], [sum(row.values())] * len(tags), len(tags)) for row in step])
    return Tagger(tags, emitted(table["word"]), emitted(table["ending"]), steps)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved model; ``NoTagger`` if there is none that can be read, or it isn't one."""
    try:
        found = spark.read.parquet(path).select("kind", "key", "tag", F.col("n").cast("long").alias("n"))
        if found.limit(2 * KEPT * 256).isEmpty():
            raise ValueError("it has no rows")
        return found
    except Exception as e:
        raise NoTagger(f"could not load the tagger {path!r}: {str(e).splitlines()[0][:200]}") from e


KEYS = "Record_ID string, Source_Row long, Source_Column string, chunk int"


def sliced(batches: Iterator[pa.RecordBatch], most: int = WORDS, column: int = 4) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``most`` words (in ``column``), or of one chunk: what a worker takes apart at once."""
    for b in batches:
        for a, z in cuts(sizes_of(b.column(column)), most):
            yield b.slice(a, z - a)


def tags_of(own: Tagger, said: pa.Array) -> pa.Array:
    """The tags of all words of the lists ``said``."""
    found = own.paths(*kinds_of(said.flatten()), sizes_of(said))
    return pa.array(own.tags, pa.string()).take(pa.array(found))


def tag(spoken: DataFrame, model: Tagger) -> DataFrame:
    """Keys of the chunk, words and their tags, for ``spoken`` (see :func:`words`)."""
    shared = spoken.sparkSession.sparkContext.broadcast(model)  # bounded by KEPT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in sliced(batches):
            said = b.column(4)
            yield pa.RecordBatch.from_arrays([*b.columns, lists_of(tags_of(own, said), sizes_of(said))], names=[*gaps.CHUNK, "words", "tags"])

    typed = spoken.select("Record_ID", F.col("Source_Row").cast("long"), "Source_Column", F.col("chunk").cast("int"), "words")
    return typed.mapInArrow(run, f"{KEYS}, words array<string>, tags array<string>")


def dependency(pos: str, after: str) -> str:
    """By the tags of a word and the next."""
    simple = {"DET": "det", "AUX": "aux", "ADP": "prep"}.get(pos)
    if simple:
        return simple
    if pos == "ADJ" and (after in NOUNS or after == "ADJ"):
        return "amod"
    if pos in ("NUM", *NOUNS) and after in NOUNS:
        return "nummod" if pos == "NUM" else "compound"
    return "dep"


def structure(said: pa.Array, tags: pa.Array, sizes: np.ndarray) -> pa.StructArray:
    """The structure (:data:`gapline.operators.gaps.PARSED`) of words, with their tags, of chunks of ``sizes`` words that lie one after another."""
    kinds, ids = kinds_of(said)
    names, pos = kinds_of(tags)
    n, begins, filled = len(ids), (np.cumsum(sizes) - sizes)[sizes > 0], sizes[sizes > 0]
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[begins] = last[begins + filled - 1] = True

    def before_own(x: np.ndarray) -> np.ndarray:
        """What has been counted up to the chunk's begin."""
        return np.repeat(x[begins], filled)

    after = np.where(last, len(names), np.roll(pos, -1))
    deps = [dependency(p, a) for p in names for a in (*names, "")]
    dep = pa.array(deps, pa.string()).take(pa.array(pos * (len(names) + 1) + after))
    ends = np.array([w in (".", "!", "?") for w in kinds], bool)[ids]
    nominal = np.array([t in NOMINAL for t in names], bool)[pos]
    head = nominal & (first | ~np.roll(nominal, 1))
    sentence = np.cumsum(ends) - ends
    group = np.cumsum(head)
    fields = {
        "text": said,
        "pos": tags,
        "dep": dep,
        "sentence": pa.array(sentence - before_own(sentence), pa.int32()),
        "ends": pa.array(ends),
        "punct": pc.equal(tags, "PUNCT"),
        "noun_chunk": pa.array(group - before_own(group - head), pa.int32(), mask=~nominal),
    }
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def shallow(said: list[str], tags: list[str]) -> list[dict]:
    """The structure of one chunk's words."""
    return structure(pa.array(said, pa.string()), pa.array(tags, pa.string()), np.array([len(said)])).to_pylist()


def parse(tagged: DataFrame) -> DataFrame:
    """Keys of the chunk and parsed (:data:`gapline.operators.gaps.PARSED`), from :func:`tag`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            said, tags = b.column(4), b.column(5)
            made = lists_of(structure(said.flatten(), tags.flatten(), sizes_of(said)), sizes_of(said))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], made], names=[*gaps.CHUNK, "parsed"])

    return tagged.mapInArrow(run, f"{KEYS}, parsed {gaps.PARSED}")


def align_key(text: str) -> str:
    """As :func:`gapline.operators.gaps.align_key`, for the tokens that texts here are cut into: no other letters than those of ASCII."""
    low = text.lower().replace("’", "'")
    return "" if low == C.EVENT.lower() else re.sub(r"^\W+|\W+$", "", low)


def placed(tokens: pa.Array, said: pa.Array) -> np.ndarray:
    """The place of each token among all words of the lists ``said``, or -1 (see :func:`gapline.operators.gaps.aligned`)."""
    (kinds, ids), (own_kinds, own_ids) = kinds_of(tokens.flatten()), kinds_of(said.flatten())
    keys = [align_key(t) for t in kinds]
    keys = [k if k or t in C.PUNCTUATION else None for k, t in zip(keys, kinds, strict=True)]
    own_keys = [align_key(t) for t in own_kinds]
    out, a, b = [], 0, 0
    for n, m in zip(sizes_of(tokens).tolist(), sizes_of(said).tolist(), strict=True):
        found = gaps.places([keys[k] for k in ids[a : a + n].tolist()], [own_keys[k] for k in own_ids[b : b + m].tolist()])
        out += [-1 if p is None else b + p for p in found]
        a, b = a + n, b + m
    return np.array(out, np.int64)


def of_gaps(parsed: pa.StructArray, at: np.ndarray, first: np.ndarray) -> pa.StructArray:
    """The features (:data:`gapline.operators.gaps.FEATURES`) of the gap before each token; null where a side has no place ``at`` in ``parsed``, and before
    the ``first`` token of a chunk."""
    left = np.roll(at, 1)
    lost = first | (left < 0) | (at < 0)
    l, r = ({k: pc.struct_field(x, k) for k in ("text", "pos", "dep", "sentence", "ends", "punct", "noun_chunk")} for x in (
        parsed.take(pa.array(place, mask=lost)) for place in (left, at)))
    same = pc.equal(l["sentence"], r["sentence"])
    fields = {
        "left_pos": l["pos"],
        "right_pos": r["pos"],
        "left_dep": l["dep"],
        "right_dep": r["dep"],
        "right_lower": pc.utf8_lower(r["text"]),
        "right_is_punct": r["punct"],
        "same_sentence": same,
        "sentence_boundary": pc.or_(pc.invert(same), l["ends"]),
        "inside_noun_chunk": pc.fill_null(pc.equal(l["noun_chunk"], r["noun_chunk"]), False),
    }
    return pa.StructArray.from_arrays(list(fields.values()), list(fields), mask=pa.array(lost))


def with_parser(chunked: DataFrame, model: Tagger) -> DataFrame:
    """``chunked`` (see :func:`gapline.operators.gaps.chunks`) with p_: for each token the features (:data:`gapline.operators.gaps.FEATURES`) of the gap
    before it, or null. They are found where the chunk's tokens are, in one Python call; no row is joined. Chunks with a null key have none, as in a join.
    Plans lose track of partitions where Python runs, so before windows the chunks are dealt again (:func:`gapline.operators.gaps.dealt`)."""
    shared = chunked.sparkSession.sparkContext.broadcast(model)  # bounded by KEPT

    said_at, tokens_at = len(chunked.columns), chunked.columns.index("tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in sliced(batches, column=said_at):
            tokens, said = b.column(tokens_at), b.column(said_at)
            sizes = sizes_of(tokens)
            parsed = structure(said.flatten(), tags_of(own, said), sizes_of(said))
            made = lists_of(of_gaps(parsed, placed(tokens, said), firsts_of(sizes)), sizes)
            yield pa.RecordBatch.from_arrays([*b.columns[:said_at], made], names=[*b.schema.names[:said_at], "p_"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in chunked.schema]
    found = chunked.withColumn("words", taken_apart(F.col("tokens"))).mapInArrow(run, ", ".join([*kept, f"p_ array<{gaps.FEATURES}>"]))
    none = F.array_repeat(F.lit(None).cast(gaps.FEATURES), F.size("tokens"))
    return found.withColumn("p_", F.when(F.expr(" and ".join(f"{k} is not null" for k in gaps.RECORD)), F.col("p_")).otherwise(none))


def legality(chunked: DataFrame, path: str) -> DataFrame | None:
    """What :func:`gapline.operators.gaps.score` takes as its parser, by the tagger saved at ``path``; a warning and none if it can't be loaded."""
    try:
        model = tagger(load(chunked.sparkSession, path))
    except NoTagger as e:
        warnings.warn(f"{e}; legality is judged by the word rules alone", stacklevel=2)
        return None
    return gaps.parser_legality(gaps.features_of(with_parser(chunked, model)))
