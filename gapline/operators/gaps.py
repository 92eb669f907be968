"""Scores for every gap between adjacent tokens.

``transcripts`` has the keys Record_ID, Source_Row, Source_Column and text. A text is split into chunks at event marks; tokens
are exploded once and one exchange on (record, chunk) serves all windows, the valley test and decoding. Windows are linear in the
text's length, whatever it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gapline import config as C
from gapline.config import Config, Vocabulary
from gapline.functions import sequence
from gapline.functions import text as T
from gapline.operators import encoders

RECORD = ("Record_ID", "Source_Row", "Source_Column")
CHUNK = (*RECORD, "chunk")
PARSER = (
    "spacy_legality",
    "spacy_legality_reason",
    "spacy_left_pos",
    "spacy_right_pos",
    "spacy_left_dep",
    "spacy_right_dep",
    "spacy_same_sentence",
    "spacy_sentence_boundary",
    "spacy_inside_noun_chunk",
)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a record together, in as many partitions as shuffles have. Tokens and gaps are tens of times as large as the texts by whose bytes adaptive
    execution would join partitions, so their number is given. Source_Column, often a constant, isn't dealt by: plans lose track of it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *RECORD[:2])


def chunks(transcripts: DataFrame, clean_text: bool = True) -> DataFrame:
    """Keys, chunk, tokens, offset (its first token's place in the record, event marks counted), truncated."""
    body = transcripts.select(*RECORD, T.normalize(F.col("text"), clean_text).alias("text")).where("text <> ''")
    parts = dealt(body).select(
        *RECORD,
        T.truncated(F.col("text")).alias("truncated"),
        F.posexplode(F.split("text", C.EVENT)).alias("chunk", "part"),
    )
    parts = parts.withColumn("tokens", T.tokenize(F.col("part"))).drop("part")
    w = Window.partitionBy(*RECORD).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(F.size("tokens") + 1).over(w), F.lit(0)).cast("int"))


def tokens(chunked: DataFrame) -> DataFrame:
    """One row for each token of each chunk of two tokens or more, with s_ and p_ if the chunks have them (see
    :func:`gapline.operators.continuity.with_continuity` and :func:`gapline.operators.tagging.with_parser`)."""
    out = chunked.withColumn("n_tokens", F.size("tokens")).where("n_tokens > 1")
    if beside := [x for x in ("s_", "p_") if x in chunked.columns]:
        each = F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), *[F.col(x).alias(x) for x in beside])).alias("pos", "x")
        return out.select(*CHUNK, "offset", "n_tokens", "truncated", each).select(*CHUNK, "offset", "n_tokens", "truncated", "pos", "x.*")
    return out.select(*CHUNK, "offset", "n_tokens", "truncated", F.posexplode("tokens").alias("pos", "token"))


def four_places(x: Column) -> Column:
    """Rounded at the scaled value, which engines do alike; a decimal rounding of the double would differ near ties."""
    return F.round(x * 10_000.0) / 10_000.0


def _within(token: Column, words: Iterable[str]) -> Column:
    return token.isin(*sorted(words)) if words else F.lit(False)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def cue_shift(left: Column, right: Column) -> Column:
    """Of two sets of cues."""
    n = F.size(left) + F.size(right)
    both = F.size(F.array_intersect(left, right))
    volume = F.least(F.lit(1.0), n / 4.0)
    one_sided = F.least(F.lit(0.4), n / 4.0)
    return F.when((F.size(left) == 0) & (F.size(right) == 0), 0.0).when(
        (F.size(left) == 0) | (F.size(right) == 0),
        one_sided,
    ).otherwise((1.0 - both / (n - both)) * volume)


def thresholded_drop(drop: Column, floor: float, ceiling: float) -> Column:
    x = drop if ceiling <= floor else (drop - floor) / (ceiling - floor)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def jaccard(left: Column, right: Column) -> Column:
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(both / (F.size(left) + F.size(right) - both))


@F.pandas_udf(DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two texts, each distinct pair of a batch once; order counts. 0 for nulls."""
    for left, right in batches:
        pairs = list(zip(left, right, strict=True))
        some = [p for p in dict.fromkeys(pairs) if p[0] is not None]
        known = dict(zip(some, sequence.ratios([a for a, _ in some], [b for _, b in some]), strict=True))
        yield pd.Series([known.get(p, 0.0) for p in pairs], dtype="float64")


def lexical(left: Column, right: Column) -> Column:
    """max(jaccard, 0.35 * sequence ratio of the sorted words); 0 if a side is empty.

    No ratio of texts of m and n characters exceeds 2 * min(m, n) / (m + n): where the jaccard index is at least 0.35 of that, none is computed."""
    a, b = (F.array_join(F.array_sort(x), " ") for x in (left, right))
    some = (F.size(left) > 0) & (F.size(right) > 0)
    most = 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))
    near = jaccard(left, right)
    needed = some & (near < 0.35 * most)
    ratio = sequence_ratio(F.when(needed, a), F.when(needed, b))
    return F.when(some, F.greatest(near, 0.35 * ratio)).otherwise(0.0)


SIMILARITY = {"jaccard": jaccard, "lexical": lexical}


def vector_similarity(left: Column, right: Column) -> Column:
    """(cosine + 1) / 2 of two float arrays, clipped; 0 for null or zero vectors."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    size = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.coalesce(F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(left, right) / size + 1.0) / 2.0))), F.lit(0.0))


def encoded_similarity(encoder: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """Similarity of the two sides' texts by their vectors. ``encoder`` maps a text column to a float array column, as a pandas UDF around a sentence
    encoder does; pass the result as ``text_similarity`` of :func:`score`."""
    return lambda left, right: vector_similarity(encoder(left), encoder(right))


def rule_reason(left: Column, right: Column) -> Column:
    """Why a gap must not be a boundary, by word lists; the first that holds, else empty."""
    a, b = F.lower(left), F.lower(right)
    return (
        F.when(right.isin(*C.PUNCTUATION), "before_punctuation")
        .when(_within(a, C.TRAILING_FUNCTION), "after_function_word")
        .when(_within(a, C.TRAILING_AUXILIARY), "after_auxiliary_or_copula")
        .when(_within(a, C.PRE_NOMINAL) & _within(b, C.TASK_NOUNS), "inside_noun_phrase")
        .when(b.isin("shaped", "shape") & ((F.length(a) == 1) | _within(a, C.PRE_NOMINAL)), "inside_compound_word")
        .when(_within(a, C.TRAILING_ADVERB) & _within(b, C.LEADING_CONTINUATION), "inside_adverbial_phrase")
        .when(_within(b, C.CONNECTORS) & ~a.isin(".", "?", "!", ";", ":"), "before_connector")
        .when(_within(a, C.MODIFIERS), "after_modifier")
        .otherwise("")
    )


#: what a parser says of a gap
FEATURES = """struct<left_pos:string,right_pos:string,left_dep:string,right_dep:string,right_lower:string,right_is_punct:boolean,same_sentence:boolean,
sentence_boundary:boolean,inside_noun_chunk:boolean>"""


def judged(x: Callable[[str], Column]) -> dict[str, Column]:
    """``PARSER``, from the features of a gap by their names."""
    lp, rp, ld = x("left_pos"), x("right_pos"), x("left_dep")
    # fixed values: part-of-speech tags, dependencies and cues of the rules
    reasons = F.array_compact(
        F.array(
            F.when(x("inside_noun_chunk"), F.lit("inside_noun_chunk")),
            F.when(
                ld.isin(
                    "det",
                    "amod",
                    "compound",
                    "nummod",
                    "poss",
                    "aux",
                    "auxpass",
                    "cop",
                    "case",
                    "mark",
                ) & rp.isin("NOUN", "PROPN", "ADJ", "VERB", "AUX", "PRON", "NUM"),
                F.concat(F.lit("left_dep_"), ld, F.lit("_needs_head")),
            ),
            F.when(
                ((lp == "AUX") | ld.isin("aux", "auxpass", "cop")) & rp.isin("VERB", "AUX", "ADJ", "NOUN", "PRON", "ADV"),
                F.lit("inside_auxiliary_or_copula_phrase"),
            ),
            F.when((lp == "ADP") & rp.isin("DET", "ADJ", "NOUN", "PROPN", "PRON", "NUM"), F.lit("inside_prepositional_phrase")),
            F.when(lp.isin("ADJ", "ADV") & rp.isin("ADJ", "NOUN", "PROPN", "VERB", "AUX"), F.lit("inside_modifier_head_phrase")),
            F.when(x("right_is_punct"), F.lit("before_punctuation")),
        )
    )
    cue = x("right_lower").isin(
        "actually",
        "but",
        "so",
        "then",
        "next",
        "okay",
        "wait",
        "because",
        "however",
        "now",
        "also",
        "first",
        "again",
    )
    semi = x("same_sentence") & ~x("sentence_boundary") & ~cue & lp.isin("VERB", "NOUN", "PROPN", "ADJ", "ADV") & rp.isin(
        "NOUN",
        "PROPN",
        "PRON",
        "NUM",
        "ADJ",
        "ADV",
    )
    legality = F.when(F.size(reasons) > 0, "illegal").when(semi, "semi_legal").otherwise("legal")
    text = F.when(F.size(reasons) > 0, F.array_join(reasons, ";")).when(semi, "within_sentence_noncue_gap").otherwise("")
    return {
        "spacy_legality": legality,
        "spacy_legality_reason": text,
        "spacy_left_pos": lp,
        "spacy_right_pos": rp,
        "spacy_left_dep": ld,
        "spacy_right_dep": x("right_dep"),
        "spacy_same_sentence": x("same_sentence"),
        "spacy_sentence_boundary": x("sentence_boundary"),
        "spacy_inside_noun_chunk": x("inside_noun_chunk"),
    }


def parser_legality(features: DataFrame) -> DataFrame:
    """Legality and its reasons from a parser's features of each gap: keys, gap, left_pos, right_pos, left_dep, right_dep, right_lower,
    right_is_punct, same_sentence, sentence_boundary, inside_noun_chunk."""
    return features.select(*RECORD, "gap", *[c.alias(k) for k, c in judged(F.col).items()])


PARSED = "array<struct<text:string,pos:string,dep:string,sentence:int,ends:boolean,punct:boolean,noun_chunk:int>>"


def align_key(text: Column) -> Column:
    """What a token and a parser's token are compared by: lower case, plain apostrophes, nothing but word characters at the ends."""
    out = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    return F.when(out == C.EVENT.lower(), "").otherwise(F.regexp_replace(out, r"(?U)^\W+|\W+$", ""))


def places(wanted: list[str | None], own: list[str | None], reach: int = 4) -> list[int | None]:
    """For each of the keys ``wanted`` the place of the first of the next ``reach`` keys of ``own`` that equals it, or None. Places rise; a key that
    isn't found moves nothing on, and None isn't looked for."""
    out, at = [], 0
    for key in wanted:
        found = None
        if key is not None and key in (ahead := own[at : at + reach]):
            found = at + ahead.index(key)
            at = found + 1
        out.append(found)
    return out


def aligned(words: Column, parsed: Column, reach: int = 4) -> Column:
    """For each of ``words`` the place of its token in ``parsed`` (see ``PARSED``), or null: the first of the next ``reach`` tokens that has the same
    key (see :func:`places`). A word without a key is looked for only if it is a punctuation mark."""

    @F.arrow_udf("array<int>")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for wanted, own in columns:
            # a chunk's keys are Python objects for as long as it takes
            found = (places(w.as_py(), o.as_py() or [], reach) if w.is_valid else None for w, o in zip(wanted, own, strict=True))
            yield pa.array(found, pa.list_(pa.int32()))

    keys = F.transform(words, lambda w: F.struct(w.alias("word"), align_key(w).alias("key")))
    wanted = F.transform(keys, lambda x: F.when((x["key"] != "") | x["word"].isin(*C.PUNCTUATION), x["key"]))
    return run(wanted, F.transform(parsed, lambda x: align_key(x["text"])))


def parser_features(chunked: DataFrame, parsed: DataFrame) -> DataFrame:
    """What :func:`parser_legality` reads, for each gap whose two tokens the parser has too: ``chunked`` as of :func:`chunks`, ``parsed`` with the keys of a
    chunk and parsed (``PARSED``): a parser's tokens of the chunk's text."""
    both = chunked.join(parsed.select(*CHUNK, F.col("parsed").cast(PARSED).alias("parsed")), list(CHUNK))
    both = both.withColumn("at", aligned(F.col("tokens"), F.col("parsed")))
    # a gap's row gets its two tokens, never the whole chunk's
    pair = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("at") - 1, F.lit(1))),
        lambda k: F.struct(k.alias("k"), F.get("parsed", F.get("at", k - 1)).alias("l"), F.get("parsed", F.get("at", k)).alias("r")),
    )
    gap = both.select(*RECORD, "offset", F.inline(pair)).where("l is not null and r is not null")
    same = F.col("l.sentence") == F.col("r.sentence")
    return gap.select(
        *RECORD,
        (F.col("offset") + F.col("k")).alias("gap"),
        F.col("l.pos").alias("left_pos"),
        F.col("r.pos").alias("right_pos"),
        F.col("l.dep").alias("left_dep"),
        F.col("r.dep").alias("right_dep"),
        F.lower("r.text").alias("right_lower"),
        F.col("r.punct").alias("right_is_punct"),
        same.alias("same_sentence"),
        (~same | F.col("l.ends")).alias("sentence_boundary"),
        F.coalesce(F.col("l.noun_chunk") == F.col("r.noun_chunk"), F.lit(False)).alias("inside_noun_chunk"),
    )


def features_of(chunked: DataFrame) -> DataFrame:
    """What :func:`parser_legality` reads, from chunks that have p_ (see :func:`gapline.operators.tagging.with_parser`)."""
    each = chunked.select(*RECORD, "offset", F.posexplode("p_").alias("pos", "p_")).where("p_ is not null")
    return each.select(*RECORD, (F.col("offset") + F.col("pos")).alias("gap"), "p_.*")


def score(
    tokenized: DataFrame,
    vocabulary: Vocabulary | None = None,
    config: Config | None = None,
    parser: DataFrame | None = None,
    similarity: Callable[[Column, Column], Column] | None = None,
    text_similarity: Callable[[Column, Column], Column] | None = None,
    keep: bool = False,
) -> DataFrame:
    """Evidence of every gap of ``tokenized`` (see :func:`tokens`); ``gap`` is the right token's place in the record.

    ``config.continuity`` is jaccard, lexical or a model (see :mod:`gapline.operators.encoders`); lexical takes the place of a model that can't be
    loaded. ``similarity`` maps the two sides' word sets to a number and overrides it; so does ``text_similarity``, which gets the two
    sides' texts (see :func:`encoded_similarity`).
    ``parser`` is a table of :func:`parser_legality`; tokens that have p_ (see :func:`gapline.operators.tagging.with_parser`) need none. Without either
    only the rules hold. With ``keep`` the continuity stays as it is, as s_; tokens that have s_ are scored by it."""
    v, c = vocabulary or Vocabulary(), config or Config()
    mode = c.legality_mode.lower()
    by_parser = mode in ("spacy", "hybrid")
    beside = by_parser and parser is None and "p_" in tokenized.columns
    if beside:
        p = F.col("p_")
        tokenized = tokenized.withColumns({k: F.when(p.isNotNull(), x) for k, x in judged(p.getField).items()})
    # tokens in blocks come with those of the neighbouring blocks that windows reach (see gapline.operators.wide)
    blocks = [x for x in ("block", "own") if x in tokenized.columns]
    # what decoding hands on, and the continuity where it is known from a first pass
    carried = [x for x in ("truncated", "mark") if x in tokenized.columns]
    known = "s_" in tokenized.columns
    by = Window.partitionBy(*CHUNK, *blocks[:1]).orderBy("pos")
    w = c.context_width
    left, right, around = by.rowsBetween(-w, -1), by.rowsBetween(0, w - 1), by.rowsBetween(-w, w - 1)
    low = F.lower("token")
    base = tokenized.withColumns(
        {
            "low": low,
            "word": T.is_word(F.col("token")).cast("int"),
            "in_task": _within(low, v.task).cast("int"),
            "in_c": _within(low, v.cognitive).cast("int"),
            "in_m": _within(low, v.metacognitive).cast("int"),
            "in_a": _within(low, v.affective).cast("int"),
            "in_r": _within(low, v.structural).cast("int"),
        }
    )
    plain = F.when(F.col("token").rlike("^[A-Za-z0-9]+$"), F.col("low"))
    cue = F.when(F.col("in_c") == 1, F.col("low"))

    def density(flag: str, frame: Window) -> Column:
        return _ratio(F.sum(flag).over(frame), F.sum("word").over(frame))

    near_m, near_r = by.rowsBetween(-2, 3), by.rowsBetween(-1, 2)
    seen = base.withColumns(
        {
            "left_token": F.lag("token").over(by),
            "l_words": F.collect_set(plain).over(left),
            "r_words": F.collect_set(plain).over(right),
            "l_cues": F.collect_set(cue).over(left),
            "r_cues": F.collect_set(cue).over(right),
            "d_task": density("in_task", around),
            "d_c": density("in_c", around),
            "d_a": density("in_a", around),
            "d_m": density("in_m", near_m),
            "d_r": density("in_r", near_r),
            "l_tokens": F.collect_list("token").over(left),
            "r_tokens": F.collect_list("token").over(right),
        }
    ).where("pos > 0")
    model = None
    if not known and similarity is None and text_similarity is None and c.continuity not in SIMILARITY:
        model = encoders.find_or_warn(tokenized.sparkSession, c.continuity)
    if known:
        out = seen.withColumnRenamed("s_", "s")
    elif text_similarity is not None:
        out = seen.withColumn("s", text_similarity(T.detokenize(F.col("l_tokens")), T.detokenize(F.col("r_tokens"))))
    elif model is not None:
        out = encoders.with_vectors(seen.drop("l_words", "r_words"), model)
        out = out.withColumn("s", vector_similarity(F.col("l_vector"), F.col("r_vector"))).drop("l_vector", "r_vector")
    else:
        alike = similarity or SIMILARITY.get(c.continuity, lexical)
        out = seen.withColumn("s", alike(F.col("l_words"), F.col("r_words")))

    def signal(d: str) -> Column:
        return F.least(F.lit(1.0), F.col(d) * 4.0)

    out = out.withColumns(
        {
            "drop": thresholded_drop(1.0 - F.col("s"), c.drop_floor, c.drop_ceiling),
            "shift": cue_shift(F.col("l_cues"), F.col("r_cues")),
            "ec": signal("d_c"),
            "m": signal("d_m"),
            "a": signal("d_a"),
            "r": signal("d_r"),
        }
    )
    gate = c.gate_floor + (1.0 - c.gate_floor) * F.col("ec")
    out = out.withColumn("c", c.semantic_weight * F.col("drop") * gate + c.cue_shift_weight * F.col("shift"))
    out = out.withColumn("p", 0.45 * F.col("c") + 0.25 * F.col("m") + 0.15 * F.col("a") + 0.15 * F.col("r"))
    out = out.withColumn("raw", F.col("s") * (1.0 + c.alpha_task_density * F.col("d_task")) - c.transition_weight * F.col("p"))

    out = out.withColumn("gap", F.col("offset") + F.col("pos"))
    none = {k: F.lit("") for k in PARSER[:6]} | {k: F.lit(None).cast("boolean") for k in PARSER[6:]}
    use_parser = beside or (by_parser and parser is not None)
    if use_parser and not beside:
        out = out.join(parser.select(*RECORD, "gap", *PARSER), [*RECORD, "gap"], "left")
    out = out.fillna("", list(PARSER[:6])) if use_parser else out.withColumns(none)
    use_rules = mode in ("rule", "hybrid") or (mode == "spacy" and not use_parser)
    out = out.withColumn("rule_constraint_reason", rule_reason(F.col("left_token"), F.col("token")) if use_rules else F.lit(""))
    illegal = F.array_compact(
        F.array(
            F.when(F.col("rule_constraint_reason") != "", F.concat(F.lit("rule:"), "rule_constraint_reason")),
            F.when(
                (F.col("spacy_legality") == "illegal") & (F.col("spacy_legality_reason") != ""),
                F.concat(F.lit("spacy:"), "spacy_legality_reason"),
            ),
        )
    )
    out = out.withColumn("constraint_reason", F.array_join(illegal, ";"))
    legality = F.when(F.col("constraint_reason") != "", "illegal").when(
        F.col("spacy_legality") == "semi_legal",
        "semi_legal",
    ).otherwise("legal")
    sentence = F.coalesce("spacy_sentence_boundary", F.lit(False)) | F.col("left_token").isin(".", "?", "!", ";", ":")
    out = out.withColumn("boundary_legality", legality)
    out = out.withColumns(
        {
            "penalty": F.when(F.col("boundary_legality") == "semi_legal", c.semi_legal_penalty).otherwise(0.0),
            "boost": F.when(sentence & (F.col("boundary_legality") != "illegal"), c.sentence_boost).otherwise(0.0),
        }
    )
    numbers = {
        "semantic_continuity": "s",
        "task_density": "d_task",
        "cognitive_transition": "c",
        "semantic_drop_component": "drop",
        "cognitive_cue_evidence": "ec",
        "cognitive_cue_shift": "shift",
        "metacognitive_reset": "m",
        "affective_friction": "a",
        "structural_break": "r",
        "transition_pressure": "p",
        "raw_semantic_gravity": "raw",
    }
    context = F.concat(T.detokenize(F.col("l_tokens")), F.lit(" <BOUNDARY> "), T.detokenize(F.col("r_tokens")))
    return out.select(
        *CHUNK,
        "offset",
        "n_tokens",
        "pos",
        "gap",
        *blocks,
        *carried,
        *([F.col("s").alias("s_")] if keep else []),
        "left_token",
        F.col("token").alias("right_token"),
        *[four_places(F.col(x)).alias(k) for k, x in numbers.items()],
        four_places(F.col("raw") + F.col("penalty") - F.col("boost")).alias("semantic_gravity"),
        "boundary_legality",
        F.array_join(
            F.array_compact(F.array(F.nullif("constraint_reason", F.lit("")), F.nullif("spacy_legality_reason", F.lit("")))),
            ";",
        ).alias("legality_reason"),
        F.round("penalty", 4).alias("legality_penalty"),
        F.round("boost", 4).alias("sentence_boundary_boost"),
        "rule_constraint_reason",
        *PARSER,
        "constraint_reason",
        context.alias("context"),
    )
