"""Parameters, vocabularies and rule lexicons of the segmenter."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

# Defaults, word lists and lexicons that decide results.
EVENT = "<EVENT>"
PUNCTUATION = (".", "!", "?", ";", ":", ",")
SIGNALS = ("C_t", "M_t", "A_t", "R_t")
SIGNAL_COLUMNS = {"C_t": "cognitive_transition", "M_t": "metacognitive_reset", "A_t": "affective_friction", "R_t": "structural_break"}
TYPE_NAMES = {"C_t": "cognitive", "M_t": "metacognitive", "A_t": "affective", "R_t": "structural"}
PRIMARY_TYPES = ("cognitive", "metacognitive", "affective", "structural", "task", "mixed", "none")


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


TASK = _words("""rotate turn turned flip flipped fit fits match matches compare align put make same equal together apart triangle triangles square
squares rectangle circle shape shapes piece pieces line lines angle point corner edge top bottom side middle center left right front back big bigger
small smaller long longer short wide wider skinny skinnier straight flat curve size sizes""")
COGNITIVE = _words("""rotate turn turned flip flipped move moved slide compare match matches fit fits align put try change different same start switch
instead maybe wait actually wrong nevermind draw drawing""")
METACOGNITIVE = _words(
    "think guess maybe wait wrong sure check know realize realized notice noticed confused hmm actually probably might nevermind no"
)
AFFECTIVE = _words("frustrating frustrated ugh hard easy tricky confusing good bad mad laughter like hate")
STRUCTURAL = _words("then next first because so but however again also now okay")
DETERMINERS = _words("a an the this that these those my your his her its their our")
TRAILING_FUNCTION = DETERMINERS | _words("""and or but because so if when while with without of to for from in on at by as than into about like has have had
having there here""")
PRE_NOMINAL = _words("""right left big bigger small smaller little long longer short wide wider skinny skinnier straight flat curvy curved slanted equal
same middle top bottom thin thick tiny large medium different similar perfect crooked round""")
TRAILING_AUXILIARY = _words("""i you we they he she it there that this i'm im i’d i'd i’ll i'll you're you’re it's it’s that's that’s there's there’s
would could should will can can't don’t don't doesn’t doesn't is are was were be been being""")
LEADING_CONTINUATION = _words("""gonna going wanna want need have has had would could should can be been being same right left triangle triangles square
squares piece pieces side sides one ones thing things more too very really like not bigger smaller different similar""")
TRAILING_ADVERB = _words("probably maybe just really very kind kinda sort sorta almost also still")
TASK_NOUNS = _words("""triangle triangles square squares rectangle rectangles circle circles shape shapes piece pieces line lines angle angles point
points corner corners edge edges side sides crescent crescents trapezoid trapezoids top bottom front back""")
TRUNCATED = _words("pa indentatio uninte t thi prob sec rectangl on th sam")
COMMON_SHORT = _words("i a an to of in on it is no")
CONNECTORS = _words("but and or because so")
MODIFIERS = _words("not too more very really")
# end of fixed values


def word_set(text: str | Iterable[str]) -> frozenset[str]:
    """Lower-cased words; a string is split at white space, commas and semicolons."""
    parts = re.split(r"[\s,;]+", text) if isinstance(text, str) else text
    return frozenset(p for p in (str(x).strip().lower() for x in parts) if p)


@dataclass(frozen=True)
class Vocabulary:
    task: frozenset[str] = TASK
    cognitive: frozenset[str] = COGNITIVE
    metacognitive: frozenset[str] = METACOGNITIVE
    affective: frozenset[str] = AFFECTIVE
    structural: frozenset[str] = STRUCTURAL

    @classmethod
    def from_texts(cls, **lists: str | Iterable[str] | None) -> Vocabulary:
        return cls(**{k: word_set(v) for k, v in lists.items() if v is not None})

    def as_text(self, name: str) -> str:
        return ", ".join(sorted(getattr(self, name)))


@dataclass(frozen=True)
class Config:
    context_width: int = 12
    local_radius: int = 6
    sensitivity: float = 0.55
    min_segment_tokens: int = 12
    max_segment_tokens: int = 60
    max_segments_per_record: int = 80
    nms_radius: int = 6
    alpha_task_density: float = 0.35
    transition_weight: float = 0.55
    ambiguous_margin: float = 0.04
    drop_floor: float = 0.35
    drop_ceiling: float = 0.80
    semantic_weight: float = 0.45
    cue_shift_weight: float = 0.55
    gate_floor: float = 0.25
    legality_mode: str = "hybrid"
    semi_legal_penalty: float = 0.18
    sentence_boost: float = 0.08
    continuity: str = "lexical"
