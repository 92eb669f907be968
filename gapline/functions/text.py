"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapline.config import COMMON_SHORT, EVENT, PUNCTUATION, TRUNCATED

# Patterns and repairs.
TOKEN = r"<EVENT>|[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?|[.!?;:,]"
CUE = r"[A-Za-z]+(?:['’][A-Za-z]+)?"
WORD = r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?"
SPEAKER_LABEL = r"(?iU)\b(?:Interviewer|Interviewee|Participant|Child|Student|Researcher|Experimenter|Subject|Respondent|Speaker)\s*[A-Za-z0-9]*\s*:\s*"
LOST = "ï¿½"
CONTROLS = (("\x14", " - "), ("\x19", "'"), ("\x1c", '"'), ("\x1d", '"'), ("\xfd", ""), ("﻿", ""))
SEQUENCES = (("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€�", '"'), ("â€¦", "..."), ("â€“", " - "), ("â€”", " - "))
LOST_REPAIRS = (
    (rf"(?i)(?:{LOST})+(s|t|d|re|m|ll|ve)\b", "'$1"),
    (rf"(?:{LOST})+(cause|Cause|em)\b", "'$1"),
    (rf"(?i)\bI(?:{LOST})+(m|d|ll|ve)\b", "I'$1"),
    (rf"(?:{LOST})+", " - "),
)
REPAIRS = (
    *LOST_REPAIRS,
    (SPEAKER_LABEL, ""),
    (r"(?U)\s+-\s+-\s+", " - "),
    (r"(?U)\s+", " "),
)
SPEAKER = r"(?i)\b(Interviewer|Interviewee)(?:\s+\d+)?\s*:"
EVENT_MARK = r"(?i)\[(?:Pause|Drawing|End of Audio|Puzzle|Unintelligible|Laughter|Sighing|Rustling|[^\]]*paper[^\]]*|[^\]]*background[^\]]*)[^\]]*\]"
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
TIMESTAMP = r"\b\d{1,2}:\d{2}\b"
MENTIONED = r"(?i)\b(ET[E]?\d{2}[_-]?\d{3,5}|ET[_-]?\d{3,5})\b"
# end of fixed values
#: what a text needs for any of the repairs of characters: one of these, or the begin of a sequence
BROKEN = rf"[{''.join(a for a, _ in CONTROLS)}Â]|{'|'.join(sorted({s[:2] for s, _ in SEQUENCES}))}|{LOST}"
#: white space that isn't one blank between words
SPACES = r"(?U)\s{2,}|[\s&&[^ ]]"


def clean(text: Column) -> Column:
    """Repairs encoding artifacts, strips speaker labels and extra white space; null becomes empty. The order matters. A text without broken
    characters skips their repairs, and one without a colon has no label."""
    raw = F.coalesce(text, F.lit(""))
    out = raw
    for a, b in (*CONTROLS, ("Â", ""), *SEQUENCES):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), LOST_REPAIRS, out)
    out = F.when(raw.rlike(BROKEN), out).otherwise(raw)
    out = F.when(F.contains(raw, F.lit(":")), F.regexp_replace(out, SPEAKER_LABEL, "")).otherwise(out)
    return F.trim(F.replace(F.regexp_replace(out, SPACES, " "), F.lit(" - - "), F.lit(" - ")))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def count_artifacts(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    marks = ["\x14", "\x19", "\x1c", "\x1d", "\xfd", "\xfd", "Â", *(s for s, _ in SEQUENCES)]
    broken = reduce(lambda a, b: a + b, [occurrences(text, m) for m in marks], F.regexp_count(text, F.lit(rf"(?:{LOST})+")).cast("long"))
    labels = F.when(F.contains(text, F.lit(":")), F.regexp_count(text, F.lit(SPEAKER_LABEL)).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(text.rlike(BROKEN), broken).otherwise(F.lit(0).cast("long")) + labels


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize(text: Column, clean_text: bool = True) -> Column:
    """Cleaned text with `` | `` between utterances as an event."""
    out = clean(text) if clean_text else F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, SPEAKER_LABEL, "")
    return squeeze(F.replace(out, F.lit(" | "), F.lit(f" {EVENT} ")))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def detokenize(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda t: t != EVENT)
    return F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+([.!?;:,])", "$1"))


def is_word(token: Column) -> Column:
    return ~token.isin(*PUNCTUATION, EVENT)


def truncated(text: Column) -> Column:
    """Whether the text seems cut off in its last word."""
    words = F.filter(tokenize(text), lambda t: ~t.isin(*PUNCTUATION))
    last = F.lower(F.element_at(words, F.when(F.size(words) > 0, -1).otherwise(None).cast("int")))
    cut = last.isin(*TRUNCATED) | ((F.length(last) <= 4) & ~last.isin(*COMMON_SHORT))
    return F.coalesce(F.rtrim(text).rlike(r"(?U)\p{Alnum}$") & cut, F.lit(False))


def normalize_raw(text: Column) -> Column:
    """Raw document text: line ends, no-break spaces, control characters, blank runs."""
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), F.lit("\xa0"), F.lit(" "))
    out = F.regexp_replace(out, CONTROL_CHARS, "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def raw_artifacts(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.regexp_count(text, F.lit(rf"(?:{LOST})+")) + F.regexp_count(text, F.lit(CONTROL_CHARS))).cast("long") + occurrences(text, "�")


def source_id(stem: Column) -> Column:
    return F.upper(F.replace(F.coalesce(stem, F.lit("")), F.lit("-"), F.lit("_")))


def mentioned_id(text: Column) -> Column:
    return F.upper(F.replace(F.coalesce(F.regexp_extract(text, MENTIONED, 1), F.lit("")), F.lit("-"), F.lit("_")))


def cue_words(text: Column) -> Column:
    """Letter words in order, as they stand."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CUE), F.lit(0))


def cue_form(words: Column) -> Column:
    """Lower-cased, with plain apostrophes."""
    return F.replace(F.lower(words), F.lit("’"), F.lit("'"))


def cues(text: Column, longest: int = 3) -> Column:
    """Distinct runs of 1 .. ``longest`` letter words, lower-cased."""
    t = F.transform(cue_words(text), cue_form)

    # the words stand beside their followers in one array, so no lambda holds the tokenizer
    beside = F.arrays_zip(*[(t if k == 0 else F.slice(t, F.lit(k + 1), F.size(t))).alias(f"w{k}") for k in range(longest)])

    def runs(x: Column) -> Column:
        w = [x[f"w{k}"] for k in range(longest)]
        return F.array_compact(F.array(*[F.when(w[k].isNotNull(), F.concat_ws(" ", *w[: k + 1])) for k in range(longest)]))

    return F.array_distinct(F.flatten(F.transform(beside, runs)))


def choice(value: Column) -> Column:
    """Label cell as text: 0/1 in any spelling, other text trimmed, blank as null."""
    t = F.trim(value.cast("string"))
    return F.when(t.isin("0", "0.0", "False", "false"), "0").when(t.isin("1", "1.0", "True", "true"), "1").when(t != "", t)


def binary_label(value: Column) -> Column:
    """1/0 from 1, true, yes, y / 0, false, no, n; also 1.0 and 0.0; else null."""
    t = F.lower(F.trim(value.cast("string")))
    return F.when(t.isin("1", "1.0", "true", "yes", "y"), 1).when(t.isin("0", "0.0", "false", "no", "n"), 0)


def strength_label(value: Column) -> Column:
    x = F.trim(value.cast("string")).try_cast("double")
    return F.when(x.isin(0.0, 1.0, 2.0, 3.0), x.cast("int"))


def as_bool(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1", "yes", "y"), F.lit(False))
