"""The older segmenter: overlapping word frames, gate weights, gravity and threshold crossings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Word lists by dimension, gate weights of the demonstration, gravity's weights.
S_WORDS = tuple("then and so because first next also".split())
M_WORDS = tuple("think guess maybe wait wrong sure check know".split())
A_WORDS = tuple("confused confusing tricky easy simple good bad laughter".split())
T_WORDS = tuple(
    """triangle triangles square squares rectangle shape shapes circle piece pieces line lines angle point corner edge big bigger small smaller little long longer
    short wide wider skinny skinnier straight flat curve size sizes top bottom side sides middle center left right front back rotate turn turned flip flipped fit
    fits match matches put make makes same equal together apart""".split()
)
# the demonstration's own, shorter lists
DEMO_A_WORDS = tuple("frustrating ugh hard stupid yay mad suck".split())
DEMO_T_WORDS = tuple("rotate triangle edge fit turn long shape size match align".split())
DIMENSIONS = ("S", "M", "A", "T")
DEMO_GATES = {"A": (0.1, 0.1, 0.8, 0.0), "M": (0.1, 0.8, 0.1, 0.0), "T": (0.1, 0.0, 0.1, 0.8), "S": (0.8, 0.1, 0.0, 0.1)}
OMEGA = (0.1, 0.8, 1.2)
BETA = 0.5
# end of fixed values


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-zA-Z\s]", ""), r"\s+"), lambda w: w != "")


def _any(words: Column, these: Sequence[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in these]))


def silver_label(text: Column) -> Column:
    """2 (A), 1 (M), 3 (T) or 0 (S): the first dimension in that order with a word in the text."""
    w = plain_words(text)
    return F.when(_any(w, A_WORDS), 2).when(_any(w, M_WORDS), 1).when(_any(w, T_WORDS), 3).otherwise(0)


def has_task(text: Column, words: Sequence[str] = T_WORDS) -> Column:
    return F.when(_any(plain_words(text), words), 1.0).otherwise(0.0)


def frames(texts: DataFrame, size: int = 5, stride: int = 1, short: bool = False) -> DataFrame:
    """id, i, frame, n_words for ``texts`` (id, text): word windows. Texts shorter than a window give one frame if ``short``, else none."""
    return _framed(texts, size, stride, short, "frame")


def framed_words(texts: DataFrame, size: int = 5, stride: int = 1) -> DataFrame:
    """:func:`frames` with plain words in the place of text: those of a text are made once, not again in each frame that holds them."""
    return _framed(texts, size, stride, False, "words")


def _framed(texts: DataFrame, size: int, stride: int, short: bool, what: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    t = texts.select("id", words.alias("w")).withColumn("n_words", F.size("w")).where(
        (F.col("n_words") > 0) if short else (F.col("n_words") >= size)
    )
    if what == "words":
        # one plain word or nothing for each word: what is taken out can't join or part two of them
        t = t.withColumn("w", F.transform("w", lambda x: F.regexp_replace(F.lower(x), r"[^a-zA-Z]", "")))

    def own(at: Column) -> Column:
        part = F.slice("w", at + 1, F.lit(size))
        return F.struct(at.alias("at"), (F.array_join(part, " ") if what == "frame" else part).alias(what))

    last = F.greatest(F.lit(0), F.col("n_words") - size)
    # a frame's row gets its own words, never the whole text's
    t = t.select("id", "n_words", F.inline(F.transform(F.sequence(F.lit(0), last, F.lit(stride)), own)))
    return t.select("id", F.expr(f"cast(at div {stride} as int)").alias("i"), what, "n_words")


def by_words(of_words: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Gates of a frame that read nothing but its plain words; ``of_words`` gives them for words that are known."""

    def gates(frame: Column) -> Column:
        return F.transform(F.array(plain_words(frame)), of_words)[0]  # the words are made plain once

    gates.of_words = of_words
    return gates


def frames_for(gates: Callable[[Column], Column], texts: DataFrame, size: int, stride: int = 1) -> DataFrame:
    """Frames as ``gates`` read them."""
    return framed_words(texts, size, stride) if hasattr(gates, "of_words") else frames(texts, size, stride)


def _gates_of(framed: DataFrame, gates: Callable[[Column], Column]) -> Column:
    return gates.of_words(F.col("words")) if "words" in framed.columns else gates(F.col("frame"))


@by_words
def demo_gates(words: Column) -> Column:
    """Fixed weights (S, M, A, T) by the frame's words, A before M before T."""
    lit = {k: F.array(*[F.lit(x) for x in v]) for k, v in DEMO_GATES.items()}
    return F.when(
        _any(words, DEMO_A_WORDS),
        lit["A"],
    ).when(_any(words, M_WORDS), lit["M"]).when(_any(words, DEMO_T_WORDS), lit["T"]).otherwise(lit["S"])


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def linear_gates(vector: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Softmax of a linear map of a vector column, without Python."""

    def dot(row: Sequence[float]) -> Column:
        return F.aggregate(
            F.zip_with(vector, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a.cast("double") * b),
            F.lit(0.0),
            lambda s, x: s + x,
        )

    return softmax(F.array(*[dot(r) + float(b) for r, b in zip(weights, bias, strict=True)]))


def train_gates(vectors: DataFrame, label: str = "label", vector: str = "vector", steps: int = 100):
    """Multinomial logistic regression of the four dimensions on vectors (array column); returns (weights, bias, accuracy)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(
        F.col(label).cast("double").alias("label"),
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
    )
    model = LogisticRegression(maxIter=steps, family="multinomial").fit(data)
    return model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist(), model.summary.accuracy


def training_set(answers: DataFrame, columns: Sequence[str], least: int = 5) -> DataFrame:
    """Texts of several columns as rows, speaker label removed, with silver labels."""
    cells = answers.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("text")).where("text is not null")
    clean = F.trim(F.replace("text", F.lit("Interviewee:"), F.lit("")))
    return cells.select(clean.alias("text")).where(F.length("text") >= least).withColumn("label", silver_label(F.col("text")))


def gravity(gates: Column, task: Column) -> Column:
    pull = gates[3] * (1.0 + BETA * task)
    return pull - (gates[0] * OMEGA[0] + gates[1] * OMEGA[1] + gates[2] * OMEGA[2])


def scored_frames(framed: DataFrame, gates: Callable[[Column], Column] = demo_gates, task_words: Sequence[str] = T_WORDS) -> DataFrame:
    """Adds gates and gravity; ``framed`` is of :func:`frames`, or of :func:`framed_words` for gates of :func:`by_words`."""
    known = "words" in framed.columns
    task = F.when(_any(F.col("words"), task_words), 1.0).otherwise(0.0) if known else has_task(F.col("frame"), task_words)
    out = framed.withColumn("gates", _gates_of(framed, gates))
    return out.withColumn("gravity", F.round(gravity(F.col("gates"), task), 6)).drop("words")


def units(texts: DataFrame, scored: DataFrame, size: int = 5, stride: int = 1, threshold: float = 0.35) -> DataFrame:
    """id, unit (from 1), a, z, text: word runs between threshold crossings. A falling crossing cuts behind its frame, a rising one
    before it; a cut counts if it is beyond all earlier ones."""
    by = Window.partitionBy("id").orderBy("i")
    low = scored.withColumn("low", F.col("gravity") < threshold).withColumn("was", F.lag("low").over(by))
    flip = low.where("was is not null and low <> was").withColumn(
        "cut",
        F.least(F.when(F.col("low"), F.col("i") * stride + size - 1).otherwise(F.col("i") * stride), F.col("n_words")),
    )
    beyond = F.coalesce(F.max("cut").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = flip.withColumn("beyond", beyond).where("cut > beyond").select("id", F.col("cut").alias("at"))
    ends = scored.where("i = 0").select("id", "n_words").distinct()
    marks = cuts.unionByName(ends.select("id", F.lit(0).alias("at"))).unionByName(
        ends.select("id", F.col("n_words").alias("at"))
    ).distinct()
    w = Window.partitionBy("id").orderBy("at")
    spans = marks.select(
        "id",
        F.col("at").alias("a"),
        F.lead("at").over(w).alias("z"),
        F.row_number().over(w).alias("unit"),
    ).where("z is not null")
    words = texts.select("id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    return spans.join(words, "id").select(
        "id",
        "unit",
        "a",
        "z",
        F.array_join(F.slice("w", F.col("a") + 1, F.col("z") - F.col("a")), " ").alias("text"),
    )


def q_matrix(unit_table: DataFrame, gates: Callable[[Column], Column] = demo_gates, size: int = 5, least: int = 3) -> DataFrame:
    """Units of ``least`` words or more, numbered anew, with mean gate weights and their greatest dimension; units shorter than a
    frame have zero weights and dimension None."""
    keep = unit_table.where(F.col("z") - F.col("a") >= least).withColumn(
        "EDU_Index",
        F.row_number().over(Window.partitionBy("id").orderBy("unit")),
    )
    # frames are many times as large as units, by whose bytes adaptive execution would join partitions
    parts = int(keep.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = keep.select(F.struct("id", "EDU_Index").alias("id"), "text").repartition(parts, "id")
    framed = frames_for(gates, own, size)
    g = framed.withColumn("g", _gates_of(framed, gates))
    mean = g.groupBy("id").agg(*[F.avg(F.col("g")[k]).alias(f"w{k}") for k in range(4)])
    out = keep.select("id", "EDU_Index", "text").join(
        mean.select("id.id", "id.EDU_Index", *[f"w{k}" for k in range(4)]),
        ["id", "EDU_Index"],
        "left",
    )
    best = F.greatest(*[F.round(f"w{k}", 9) for k in range(4)])
    dim = F.lit(None).cast("string")
    for k in (3, 2, 1, 0):
        dim = F.when(F.round(f"w{k}", 9) == best, DIMENSIONS[k]).otherwise(dim)
    out = out.withColumn("Dominant_Dim", F.coalesce(dim, F.lit("None")))
    return out.select(
        F.col("id").alias("Student_ID"),
        "EDU_Index",
        F.col("text").alias("EDU_Text"),
        "Dominant_Dim",
        *[(F.col("Dominant_Dim") == d).cast("int").alias(f"Q_{d}") for d in DIMENSIONS],
        *[
            (F.round(F.round(F.coalesce(f"w{k}", F.lit(0.0)), 9) * 10_000.0) / 10_000.0).alias(f"Weight_{d}")
            for k, d in enumerate(DIMENSIONS)
        ],
    )


def batch(
    answers: DataFrame,
    gates: Callable[[Column], Column] = demo_gates,
    size: int = 5,
    stride: int = 1,
    threshold: float = 0.35,
) -> DataFrame:
    """The batch run: ``answers`` (id, text with `` | `` between turns) to a Q-matrix."""
    texts = answers.select("id", F.replace(F.coalesce("text", F.lit("")), F.lit(" | "), F.lit(" ")).alias("text"))
    return q_matrix(units(texts, scored_frames(frames_for(gates, texts, size, stride), gates), size, stride, threshold), gates, size)
