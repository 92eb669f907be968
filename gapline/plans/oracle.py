"""The queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from dataclasses import asdict

from gapline import config as C
from gapline.functions import text as T
from gapline.operators import frames, qc, tagging
from gapline.plans.queries import CONFIG, ENDINGS, GATE_WORDS, LOW, POS, WORDS


def q(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r4(x: str) -> str:
    return f"(round(({x}) * 10000.0::double) / 10000.0::double + 0.0::double)"


TOKEN, CUE, WORD, SPEAKER = (lit(x) for x in (T.TOKEN, T.CUE, T.WORD, T.SPEAKER))
LABEL = lit(T.SPEAKER_LABEL.replace("(?iU)", "(?i)"))
DETOK = "trim(regexp_replace(array_to_string(list_filter({0}, lambda t: t <> '<EVENT>'), ' '), '\\s+([.!?;:,])', '\\1', 'g'))"
PUNCT = q(C.PUNCTUATION)
w = CONFIG.context_width
r = CONFIG.local_radius

TRANSCRIPTS = f"""t0 as (select conv_id || '_' || turn rid, cast(turn as bigint) src,
  trim(regexp_replace(replace(regexp_replace(coalesce(text, ''), {LABEL}, '', 'g'), ' | ', ' <EVENT> '), '\\s+', ' ', 'g')) txt from conversations),
parts as (select rid, src, unnest(string_split(txt, '<EVENT>')) part, generate_subscripts(string_split(txt, '<EVENT>'), 1) - 1 chunk from t0 where txt <> ''),
lists as (select rid, src, chunk, regexp_extract_all(part, {TOKEN}) toks from parts),
placed as (select *, coalesce(sum(len(toks) + 1) over (partition by rid, src order by chunk rows between unbounded preceding and 1 preceding), 0) off from lists),
tok as (select rid, src, chunk, off, len(toks) n, unnest(toks) token, generate_subscripts(toks, 1) - 1 pos from placed where len(toks) > 1)"""

FLAGS = f"""flagged as (select *, lower(token) low, case when token in ({PUNCT}, '<EVENT>') then 0 else 1 end wd,
  case when lower(token) in ({q(WORDS.task)}) then 1 else 0 end ft, case when lower(token) in ({q(WORDS.cognitive)}) then 1 else 0 end fc,
  case when lower(token) in ({q(WORDS.metacognitive)}) then 1 else 0 end fm, case when lower(token) in ({q(WORDS.affective)}) then 1 else 0 end fa,
  case when lower(token) in ({q(WORDS.structural)}) then 1 else 0 end fr, regexp_full_match(token, '[A-Za-z0-9]+') plain from tok),
ctx as (select *, lag(token) over p as left_token,
  coalesce(sum(ft) over a / nullif(sum(wd) over a, 0), 0.0) dt, coalesce(sum(fc) over a / nullif(sum(wd) over a, 0), 0.0) dc,
  coalesce(sum(fa) over a / nullif(sum(wd) over a, 0), 0.0) da,
  coalesce(sum(fm) over (p rows between 2 preceding and 3 following) / nullif(sum(wd) over (p rows between 2 preceding and 3 following), 0), 0.0) dm,
  coalesce(sum(fr) over (p rows between 1 preceding and 2 following) / nullif(sum(wd) over (p rows between 1 preceding and 2 following), 0), 0.0) dr,
  coalesce(list_distinct(list(low) filter (where plain) over l), []) lw, coalesce(list_distinct(list(low) filter (where plain) over g), []) rw,
  coalesce(list_distinct(list(low) filter (where fc = 1) over l), []) lc, coalesce(list_distinct(list(low) filter (where fc = 1) over g), []) rc
  from flagged window p as (partition by rid, src, chunk order by pos), a as (partition by rid, src, chunk order by pos rows between {w} preceding and {w - 1} following),
  l as (partition by rid, src, chunk order by pos rows between {w} preceding and 1 preceding), g as (partition by rid, src, chunk order by pos rows between current row and {w - 1} following)),
base as (select *, off + pos gap, len(list_intersect(lw, rw)) iw, len(list_intersect(lc, rc)) ic from ctx where pos > 0)"""

JACCARD = "case when len(lw) = 0 or len(rw) = 0 then 0.0 else iw / (len(lw) + len(rw) - iw) end"


def signals(similarity: str = JACCARD, sides: str = "base") -> str:
    """Scores of the gaps of ``sides``, with ``similarity`` as their continuity."""
    return f"""sig as (select *, {similarity} s,
  case when len(lc) = 0 and len(rc) = 0 then 0.0 when len(lc) = 0 or len(rc) = 0 then least(0.4::double, (len(lc) + len(rc)) / 4.0::double)
    else (1.0::double - ic / (len(lc) + len(rc) - ic)) * least(1.0::double, (len(lc) + len(rc)) / 4.0::double) end sh,
  least(1.0::double, dc * 4.0::double) ec, least(1.0::double, dm * 4.0::double) m, least(1.0::double, da * 4.0::double) a, least(1.0::double, dr * 4.0::double) rr from {sides}),
sig2 as (select *, greatest(0.0::double, least(1.0::double, (1.0::double - s - {CONFIG.drop_floor}::double) / ({CONFIG.drop_ceiling - CONFIG.drop_floor}::double))) dp from sig),
sig3 as (select *, 0.45::double * dp * (0.25::double + 0.75::double * ec) + 0.55::double * sh c from sig2),
sig4 as (select *, 0.45::double * c + 0.25::double * m + 0.15::double * a + 0.15::double * rr p from sig3),
sig5 as (select *, s * (1.0::double + 0.35::double * dt) - 0.55::double * p raw from sig4),
legal as (select *, case when token in ({PUNCT}) then 'before_punctuation' when lower(left_token) in ({q(C.TRAILING_FUNCTION)}) then 'after_function_word'
  when lower(left_token) in ({q(C.TRAILING_AUXILIARY)}) then 'after_auxiliary_or_copula'
  when lower(left_token) in ({q(C.PRE_NOMINAL)}) and low in ({q(C.TASK_NOUNS)}) then 'inside_noun_phrase'
  when low in ('shaped', 'shape') and (length(left_token) = 1 or lower(left_token) in ({q(C.PRE_NOMINAL)})) then 'inside_compound_word'
  when lower(left_token) in ({q(C.TRAILING_ADVERB)}) and low in ({q(C.LEADING_CONTINUATION)}) then 'inside_adverbial_phrase'
  when low in ({q(C.CONNECTORS)}) and lower(left_token) not in ('.', '?', '!', ';', ':') then 'before_connector'
  when lower(left_token) in ({q(C.MODIFIERS)}) then 'after_modifier' else '' end reason from sig5),
gaps as (select *, case when left_token in ('.', '?', '!', ';', ':') and reason = '' then 0.08::double else 0.0::double end boost from legal),
scored as (select *, {r4('raw + 0.0::double - boost')} g, cast(round({r4('raw + 0.0::double - boost')} * 10000) as bigint) k from gaps)"""


#: the longest common block of two texts first, then what is left and right of it: cells that agree, their runs on diagonals, and the runs of each
#: part of the table (known by its first row) cut at its block, until none is left
BLOCKS = """texts as (select *, array_to_string(list_sort(lw), ' ') ta, array_to_string(list_sort(rw), ' ') tb from base),
pairs as (select row_number() over () pid, ta, tb from (select distinct ta, tb from texts where ta <> '' and tb <> '')),
ca as (select pid, unnest(range(length(ta))) i, unnest(string_split(ta, '')) c from pairs),
cb as (select pid, unnest(range(length(tb))) j, unnest(string_split(tb, '')) c from pairs),
agree as (select pid, i, j, i - row_number() over (partition by pid, i - j order by i) g from ca join cb using (pid, c)),
runs as (select pid, 0::bigint part, min(i) i, min(j) j, count(*) n, 0 depth from agree group by pid, i - j, g),
cuts as (select * from runs union all select pid, u.part, u.i, u.j, u.n, depth + 1 from (select pid, depth, unnest([
    {'part': part, 'i': i, 'j': j, 'n': least(n, b.i - i, b.j - j)},
    {'part': b.i + b.n, 'i': i + greatest(0, b.i + b.n - i, b.j + b.n - j), 'j': j + greatest(0, b.i + b.n - i, b.j + b.n - j), 'n': n - greatest(0, b.i + b.n - i, b.j + b.n - j)}]) u
  from (select *, first({'i': i, 'j': j, 'n': n}) over (partition by pid, part order by n desc, i, j) b from cuts)) where u.n > 0),
sums as (select pid, sum(n) m from (select pid, depth, part, max(n) n from cuts group by all) group by pid),
sided as (select texts.*, coalesce(2.0::double * m / (length(ta) + length(tb)), 0.0::double) ratio from texts left join pairs using (ta, tb) left join sums using (pid))"""
LEXICAL = f"case when len(lw) = 0 or len(rw) = 0 then 0.0::double else greatest({JACCARD}, 0.35::double * ratio) end"

#: sums of the words' vectors over both sides of each gap; a word's place is 1 if that digit of its hash is at least 8
PLACES = range(16)
_UNIT = ", ".join(f"case when not wd2 then 0 when md5('gap:0:' || low)[{k + 1}] >= '8' then 1 else -1 end v{k}" for k in PLACES)
_DOT = lambda x, y: "(" + " + ".join(f"{x}{k} * {y}{k}" for k in PLACES) + ")::double"
VECTORS = f"""unit as (select rid, src, chunk, pos, {_UNIT} from (select *, regexp_matches(token, '[A-Za-z0-9]') wd2 from flagged)),
vec as (select rid, src, chunk, pos, {", ".join(f"coalesce(sum(v{k}) over l, 0) l{k}, sum(v{k}) over g g{k}" for k in PLACES)} from unit
  window l as (partition by rid, src, chunk order by pos rows between {w} preceding and 1 preceding), g as (partition by rid, src, chunk order by pos rows between current row and {w - 1} following)),
met as (select rid, src, chunk, pos, {_DOT("l", "g")} lg, sqrt({_DOT("l", "l")}) * sqrt({_DOT("g", "g")}) size from vec),
sided as (select base.*, case when size > 0 then greatest(0.0::double, least(1.0::double, (lg / size + 1.0::double) / 2.0::double)) else 0.0::double end cosine
  from base join met using (rid, src, chunk, pos))"""

VALLEY = f"""nb as (select *, count(k) over x + count(k) over y nn, coalesce(sum(k) over x, 0) + coalesce(sum(k) over y, 0) ss, coalesce(sum(k * k) over x, 0) + coalesce(sum(k * k) over y, 0) qq,
  lag(k) over z kb, lead(k) over z ka from scored window z as (partition by rid, src, chunk order by pos),
  x as (partition by rid, src, chunk order by pos rows between {r} preceding and 1 preceding), y as (partition by rid, src, chunk order by pos rows between 1 following and {r} following)),
valley as (select *, nn > 0 and nn * k < ss - {CONFIG.sensitivity}::double * sqrt(greatest(0, nn * qq - ss * ss)::double) and k <= coalesce(kb, k) and k <= coalesce(ka, k) cand from nb),
ordered as (select rid, src, chunk, any_value(n) n, list([pos] order by k, pos) filter (where cand and reason = '') cs from valley group by rid, src, chunk),
picked as (select rid, src, chunk, list_reduce(list_prepend(cast([] as bigint[]), coalesce(list_transform(cs, lambda c: list_transform(c, lambda e: e::bigint)), cast([] as bigint[][]))), lambda acc, c:
  case when c[1] >= {CONFIG.min_segment_tokens} and n - c[1] >= {CONFIG.min_segment_tokens} and len(list_filter(acc, lambda e: abs(c[1] - e) < {max(CONFIG.min_segment_tokens, CONFIG.nms_radius + 1)})) = 0 then list_concat(acc, c) else acc end) sel from ordered),
chosen as (select rid, src, chunk, unnest(sel) pos from picked)"""

WITH_GAPS = f"with recursive {TRANSCRIPTS}, {FLAGS}, {signals()}"
WITH_VALLEY = f"{WITH_GAPS}, {VALLEY}"
KEY = "rid, src, chunk"
SENTENCE_END = "('.', '?', '!', ';', ':')"


def selection(most: int) -> str:
    """Forced boundaries: one step splits the first span that is too long, until there is none or it can't be split."""
    least = CONFIG.min_segment_tokens
    span = f"r.pos between a + {least} and z - {least}"
    kinds = [f"list_filter(rs, lambda r: r.{x} and {span})" for x in ("free", "usable")]
    best = f"""list_sort(list_transform(case when len({kinds[0]}) > 0 then {kinds[0]} else {kinds[1]} end,
      lambda r: {{'b': r.bonus, 'k': r.k, 'd': abs(2 * r.pos - a - z), 'p': r.pos}}))[1].p"""
    return f"""longc as (select {KEY}, any_value(n)::bigint n, list({{'pos': pos::bigint, 'k': k, 'free': reason = '',
    'usable': token not in ({PUNCT}) and lower(left_token) not in ({q(C.TRAILING_FUNCTION)}),
    'bonus': case when left_token in {SENTENCE_END} then -3 when low in ('okay', 'then', 'but', 'and', 'wait', 'actually', 'so') then -2 else 0 end}} order by pos) rs
  from valley where n > {most} group by {KEY}),
steps as (select longc.*, list_sort(list_concat([0::bigint, n], coalesce(sel, cast([] as bigint[])))) cuts, cast([] as bigint[]) added from longc left join picked using ({KEY})
  union all select {KEY}, n, rs, list_sort(list_append(cuts, best)), list_append(added, best) from (select *, {best} best from (select *, cuts[i] a, cuts[i + 1] z
    from (select *, list_position(list_transform(range(1, len(cuts)), lambda j: cuts[j + 1] - cuts[j] > {most}), true) i from steps) where i > 0)) where best is not null),
forced as (select {KEY}, unnest(added) pos from (select *, row_number() over (partition by {KEY} order by len(added) desc) rk from steps) where rk = 1),
sel as (select {KEY}, pos, false f from chosen union all select {KEY}, pos, true from forced),
bound as (select valley.*, sel.pos is not null picked, coalesce(f, false) f, case when nn > 0 then (ss - {CONFIG.sensitivity}::double * sqrt(greatest(0, nn * qq - ss * ss)::double)) / nn / 10000 else g end t
  from valley left join sel using ({KEY}, pos))"""


def kind(means: list[str]) -> tuple[str, str]:
    """(type, confidence) of the four means."""
    names = ("cognitive", "metacognitive", "affective", "structural")
    o = "list_sort([" + ", ".join(
        f"{{'neg': -({m}), 'at': {i}, 'nm': '{n}'}}" for i, (m, n) in enumerate(zip(means, names, strict=True))
    ) + "])"
    return (
        f"case when -{o}[1].neg < 0.20 then 'low_signal' when {o}[2].neg <= -0.30 and greatest(0.0, -{o}[1].neg + {o}[2].neg) < 0.10"
        f" then 'mixed_' || {o}[1].nm || '_' || {o}[2].nm else {o}[1].nm end",
        r4(f"greatest(0.0::double, -{o}[1].neg + {o}[2].neg)"),
    )


SCORES = {
    "c": "Mean_C_t",
    "m": "Mean_M_t",
    "a": "Mean_A_t",
    "rr": "Mean_R_t",
    "g": "Mean_Semantic_Gravity",
    "dt": "Mean_Task_Density",
    "p": "Mean_Transition_Pressure",
}


def segmentation(most: int, cap: int) -> str:
    """Segments (seg: keys, idx, a, z, n, txt, typ, conf, k_c .. k_p, trunc, merged) of at most ``most`` tokens where that can be, at most ``cap`` of a record."""
    whole = {x: f"cast(round({r4(x)} * 10000) as bigint)" for x in SCORES}
    typ, conf = kind([f"m_{x}" for x in ("c", "m", "a", "rr")])
    typ2, conf2 = kind([f"s.k_{x} / 10000.0::double" for x in ("c", "m", "a", "rr")])
    pair = ", ".join(
        f"'k_{x}': (case when st[i].k_{x} + st[i + 1].k_{x} < 0 then -1 else 1 end * ((abs(st[i].k_{x} + st[i + 1].k_{x}) + 1) // 2))::bigint"
        for x in SCORES
    )
    return f"""{selection(most)},
marked as (select tok.*, sum(case when sel.pos is not null then 1 else 0 end) over (partition by tok.rid, tok.src, tok.chunk order by tok.pos) seg, sel.pos is not null cut from tok left join sel using ({KEY}, pos)),
body as (select {KEY}, seg, any_value(off) off, min(pos) a, max(pos) + 1 z, list(token order by pos) words from marked group by all),
proof as (select {KEY}, unnest(case when cut then [seg, seg - 1] else [seg] end) seg, {", ".join(f"{e} w_{x}" for x, e in whole.items())} from marked join scored using ({KEY}, pos)),
means as (select {KEY}, seg, {", ".join(f"sum(w_{x})::double / count(*) / 10000 m_{x}, (case when sum(w_{x}) < 0 then -1 else 1 end * ((2 * abs(sum(w_{x})) + count(*)) // (2 * count(*))))::bigint k_{x}" for x in SCORES)} from proof group by all),
cutoff as (select rid, src, coalesce(regexp_matches(rtrim(txt), '[\\p{{L}}\\p{{N}}]$') and (lw in ({q(C.TRUNCATED)}) or (length(lw) <= 4 and lw not in ({q(C.COMMON_SHORT)}))), false) tr
  from (select *, lower(list_filter(regexp_extract_all(txt, {TOKEN}), lambda x: x not in ({PUNCT}))[-1]) lw from t0)),
plain as (select rid, src, row_number() over (partition by rid, src order by chunk, seg) idx, off + a a, off + z z, z - a n, {DETOK.format("words")} txt, {typ} typ, {conf} conf,
  {", ".join(f"k_{x}" for x in SCORES)}, tr and lead(seg) over (partition by rid, src order by chunk, seg) is null trunc from body join means using ({KEY}, seg) join cutoff using (rid, src)),
lines as (select rid, src, list({{'idx': idx::bigint, 'a': a::bigint, 'z': z::bigint, 'n': n::bigint, 'txt': txt, 'typ': typ, 'conf': conf, {", ".join(f"'k_{x}': k_{x}" for x in SCORES)}, 'trunc': trunc, 'merged': false}} order by idx) st
  from plain group by rid, src),
joins as (select rid, src, st from lines union all select rid, src, list_concat(list_concat(st[1 : i - 1], [{{'idx': st[i].idx, 'a': st[i].a, 'z': st[i + 1].z, 'n': st[i].n + st[i + 1].n,
    'txt': st[i].txt || ' ' || st[i + 1].txt, 'typ': '', 'conf': 0.0::double, {pair}, 'trunc': st[i].trunc or st[i + 1].trunc, 'merged': true}}]), st[i + 2 :])
  from (select *, list_position(sizes, list_min(sizes)) i from (select *, list_transform(range(1, len(st)), lambda j: st[j].n + st[j + 1].n) sizes from joins where len(st) > {cap}) where list_min(sizes) <= {most})),
final as (select rid, src, unnest(st) s, generate_subscripts(st, 1) idx from (select *, row_number() over (partition by rid, src order by len(st)) rk from joins) where rk = 1),
seg as (select rid, src, idx, s.a, s.z, s.n, case when s.merged then trim(regexp_replace(s.txt, '\\s+([.!?;:,])', '\\1', 'g')) else s.txt end txt, case when s.merged then {typ2} else s.typ end typ,
  case when s.merged then {conf2} else s.conf end conf, {", ".join(f"s.k_{x} k_{x}" for x in SCORES)}, s.trunc, s.merged from final)"""


def segment_columns() -> str:
    means = {x: f'k_{x} / 10000.0::double "{n}"' for x, n in SCORES.items()}
    return f"""rid "Record_ID", src "Source_Row", 'text' "Source_Column", idx::int "Segment_Index", a::int "Token_Start", z::int "Token_End", n::int "Token_Count", txt "Segment_Text", typ "Segment_Type",
conf "Segment_Type_Confidence", {", ".join(means[x] for x in ("c", "m", "a", "rr"))}, trunc "Source_Truncation_Flag", {", ".join(means[x] for x in ("g", "dt", "p"))}, merged "Merged_By_Max_Segment_Count\""""


CONTEXT = f"""sides as (select {KEY}, pos, list(token) over l lt, list(token) over g rt from tok
  window l as (partition by {KEY} order by pos rows between {w} preceding and 1 preceding), g as (partition by {KEY} order by pos rows between current row and {w - 1} following)),
evidence as (select bound.*, {DETOK.format("lt")} || ' <BOUNDARY> ' || {DETOK.format("rt")} context, case when reason <> '' then 'rule:' || reason else '' end con,
  case when reason <> '' then 'illegal' else 'legal' end legality from bound join sides using ({KEY}, pos))"""

EVIDENCE = f"""rid "Record_ID", src "Source_Row", 'text' "Source_Column", gap::int gap, left_token, token right_token, {r4('s')} semantic_continuity, {r4('dt')} task_density, {r4('c')} cognitive_transition,
{r4('dp')} semantic_drop_component, {r4('ec')} cognitive_cue_evidence, {r4('sh')} cognitive_cue_shift, {r4('m')} metacognitive_reset, {r4('a')} affective_friction, {r4('rr')} structural_break,
{r4('p')} transition_pressure, {r4('raw')} raw_semantic_gravity, g semantic_gravity, legality boundary_legality, con legality_reason, 0.0::double legality_penalty, boost sentence_boundary_boost,
reason rule_constraint_reason, '' spacy_legality, '' spacy_legality_reason, '' spacy_left_pos, '' spacy_right_pos, '' spacy_left_dep, '' spacy_right_dep, null::boolean spacy_same_sentence,
null::boolean spacy_sentence_boundary, null::boolean spacy_inside_noun_chunk, {r4('t')} local_threshold, {r4('t - g')} boundary_margin, cand candidate_boundary, picked selected_boundary,
f forced_max_length_boundary, reason <> '' constraint_blocked, con constraint_reason, cand and t - g <= {CONFIG.ambiguous_margin}::double review_flag, context"""


def _key(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), '’', ''''), '^[^\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+$', '', 'g')"


def _tags() -> str:
    these = " ".join(f"when lw in ({q(these.split())}) then '{tag}'" for tag, these in POS)
    return these + " " + " ".join(f"when regexp_matches(lw, '({'|'.join(ends)})$') then '{tag}'" for tag, ends in ENDINGS)


def _cost(n: str, total: str, kinds: str) -> str:
    return f"floor(-1000 * ln((coalesce({n}, 0) + {tagging.ADDED}::double) / ({total} + {tagging.ADDED}::double * {kinds})) + 0.5)::bigint"


def _kept(name: str, key: str) -> str:
    """Costs by tag of the most frequent keys of ``silver``."""
    return f"""{name}_n as (select {key} key, tag, count(*) n from silver group by all),
{name}_k as (select key from {name}_n group by key order by sum(n) desc, key limit {tagging.KEPT}),
{name} as (select k.key, list({_cost("c.n", "t.n", f"((select count(*) from {name}_k) + 1)")} order by t.tag) cost from {name}_k k cross join tagn t left join {name}_n c on c.key = k.key and c.tag = t.tag group by k.key)"""


#: counts of a hidden Markov model, and the least costs by tag, word after word; back from the last word along the steps that gave them
TAGGER = f"""pp as (select {KEY}, off, toks, regexp_extract_all({DETOK.format("toks")}, {lit(tagging.TOKEN)}) pw from placed),
pw1 as (select {KEY}, pw, unnest(pw) w, generate_subscripts(pw, 1) - 1 i from pp),
said as (select *, lower(w) lw from pw1),
silver as (select *, case when regexp_full_match(lw, '[^a-z0-9]+') then 'PUNCT' when regexp_full_match(lw, '[0-9]+') then 'NUM' {_tags()} else 'NOUN' end tag
  from said where split_part(rid, '_', 1)::bigint % 2 = 0),
tagn as (select tag, count(*) n, row_number() over (order by tag) ix from silver group by tag),
{_kept("bywords", "lw")}, {_kept("byends", "right(lw, 3)")},
went as (select coalesce(lag(tag) over (partition by {KEY} order by i), '<s>') prev, tag from silver),
froms as (select prev, count(*) n from went group by prev),
stepn as (select prev, tag, count(*) n from went group by all),
stepc as (select f.prev, list({_cost("c.n", "f.n", "(select count(*) from tagn)")} order by t.tag) cost from
  (select p.prev, coalesce(n, 0) n from (select tag prev from tagn union all select '<s>') p left join froms using (prev)) f
  cross join tagn t left join stepn c on c.prev = f.prev and c.tag = t.tag group by f.prev),
hmm as (select list(cost order by prev) filter (where prev <> '<s>') step, any_value(cost) filter (where prev = '<s>') start, (select list(tag order by tag) from tagn) tags from stepc),
emit as (select {KEY}, i, w, len(pw) m, coalesce(a.cost, b.cost, list_transform(tags, lambda x: 0::bigint)) own
  from said left join bywords a on a.key = lw left join byends b on b.key = right(lw, 3) cross join hmm),
vit as (select {KEY}, i, m, list_transform(range(len(tags)), lambda t: start[t + 1] + own[t + 1]) sc, list_transform(tags, lambda x: 0::bigint) bp from emit cross join hmm where i = 0
  union all select {KEY}, i, m, list_transform(range(len(own)), lambda t: list_min(ways[t + 1]) + own[t + 1]), list_transform(ways, lambda x: list_position(x, list_min(x))::bigint)
  from (select e.rid, e.src, e.chunk, e.i, e.m, own, list_transform(range(len(own)), lambda t: list_transform(range(len(own)), lambda s: sc[s + 1] + step[s + 1][t + 1])) ways
    from vit join emit e on e.rid = vit.rid and e.src = vit.src and e.chunk = vit.chunk and e.i = vit.i + 1 cross join hmm)),
back as (select {KEY}, i, list_position(sc, list_min(sc))::bigint ix from vit where i = m - 1
  union all select {KEY}, v.i - 1, v.bp[ix] from back join vit v using ({KEY}, i) where v.i > 0),
pt as (select {KEY}, i, w, tags[ix] tag from back join said using ({KEY}, i) cross join hmm)"""

_AHEAD = "coalesce(list_position(list_transform(kt[acc.nxt + 1 : acc.nxt + 4], lambda y: y.k = x.k or y.t = x.w), true), 0)"
_ZERO = "'nxt': 0::bigint, 'pl': cast([] as bigint[])"
_HEADS = "('NOUN', 'PROPN', 'ADJ', 'VERB', 'AUX', 'PRON', 'NUM')"
PARSER = f"""{TAGGER},
px as (select *, tag in ({q(tagging.NOMINAL)}) nominal, w in ('.', '!', '?') ends from pt),
py as (select *, nominal and not coalesce(lag(nominal) over p, false) head, lead(tag) over p after from px window p as (partition by {KEY} order by i)),
pd as (select {KEY}, i, w, tag, ends, coalesce(sum(ends::int) over (p rows between unbounded preceding and 1 preceding), 0) sent,
  case when nominal then sum(head::int) over (p rows between unbounded preceding and current row) end nc,
  case when tag = 'DET' then 'det' when tag = 'AUX' then 'aux' when tag = 'ADP' then 'prep' when tag = 'ADJ' and after in ('ADJ', 'NOUN', 'PROPN') then 'amod'
    when tag = 'NUM' and after in ('NOUN', 'PROPN') then 'nummod' when tag in ('NOUN', 'PROPN') and after in ('NOUN', 'PROPN') then 'compound' else 'dep' end dep
  from py window p as (partition by {KEY} order by i)),
pk as (select *, list_transform(pw, lambda w: {{'k': {_key('w')}, 't': w}}) kt from pp where len(toks) > 0),
pa as (select {KEY}, off, list_reduce(list_prepend({{{_ZERO}, 'w': '', 'k': ''}}, list_transform(toks, lambda w: {{{_ZERO}, 'w': w, 'k': {_key('w')}}})),
  lambda acc, x: list_transform([case when x.k <> '' or x.w in ({PUNCT}) then {_AHEAD} else 0 end],
    lambda m: {{'nxt': acc.nxt + m, 'pl': list_append(acc.pl, case when m > 0 then acc.nxt + m - 1 end), 'w': '', 'k': ''}})[1]).pl pl from pk),
pi as (select *, unnest(range(1, len(pl))) j from pa),
pg as (select {KEY}, off + j gap, pl[j] li, pl[j + 1] ri from pi),
pf as (select g.rid, g.src, g.chunk, gap, l.tag lt, r.tag rt, l.dep ld, r.dep rd, lower(r.w) rw, r.tag = 'PUNCT' punct, l.sent = r.sent same, l.sent <> r.sent or l.ends sb, coalesce(l.nc = r.nc, false) nc
  from pg g join pd l on g.rid = l.rid and g.src = l.src and g.chunk = l.chunk and g.li = l.i join pd r on g.rid = r.rid and g.src = r.src and g.chunk = r.chunk and g.ri = r.i),
pq as (select *, list_filter([case when nc then 'inside_noun_chunk' end,
  case when ld in ('det', 'amod', 'compound', 'nummod', 'poss', 'aux', 'auxpass', 'cop', 'case', 'mark') and rt in {_HEADS} then 'left_dep_' || ld || '_needs_head' end,
  case when (lt = 'AUX' or ld in ('aux', 'auxpass', 'cop')) and rt in ('VERB', 'AUX', 'ADJ', 'NOUN', 'PRON', 'ADV') then 'inside_auxiliary_or_copula_phrase' end,
  case when lt = 'ADP' and rt in ('DET', 'ADJ', 'NOUN', 'PROPN', 'PRON', 'NUM') then 'inside_prepositional_phrase' end,
  case when lt in ('ADJ', 'ADV') and rt in ('ADJ', 'NOUN', 'PROPN', 'VERB', 'AUX') then 'inside_modifier_head_phrase' end,
  case when punct then 'before_punctuation' end], lambda x: x is not null) why,
  same and not sb and rw not in ('actually', 'but', 'so', 'then', 'next', 'okay', 'wait', 'because', 'however', 'now', 'also', 'first', 'again')
    and lt in ('VERB', 'NOUN', 'PROPN', 'ADJ', 'ADV') and rt in ('NOUN', 'PROPN', 'PRON', 'NUM', 'ADJ', 'ADV') halfway from pf),
parser as (select *, case when len(why) > 0 then 'illegal' when halfway then 'semi_legal' else 'legal' end leg,
  case when len(why) > 0 then array_to_string(why, ';') when halfway then 'within_sentence_noncue_gap' else '' end why_text from pq)"""

MODES = f"""pm as (select l.*, p.sb, coalesce(p.leg, '') leg, coalesce(p.why_text, '') why_text
  from legal l left join (select rid, src, gap, sb, leg, why_text from parser) p on l.rid = p.rid and l.src = p.src and l.gap = p.gap),
pc as (select *, array_to_string(list_filter([case when reason <> '' then 'rule:' || reason end, case when leg = 'illegal' and why_text <> '' then 'spacy:' || why_text end], lambda x: x is not null), ';') con from pm),
pl2 as (select *, case when con <> '' then 'illegal' when leg = 'semi_legal' then 'semi_legal' else 'legal' end bl from pc),
pb as (select *, case when bl = 'semi_legal' then 0.18::double else 0.0::double end pen,
  case when (coalesce(sb, false) or left_token in {SENTENCE_END}) and bl <> 'illegal' then 0.08::double else 0.0::double end bst from pl2)"""

_CELL = "(['0', '1.0', ' True', 'false', 'yes', 'N', '3', '2.0', '', '4', 'maybe'])[doc_id % 11 + 1]"


def _report() -> str:
    events = f"(select sum(len(regexp_extract_all(raw, {lit(T.EVENT_MARK)}))) from turns)"
    words = f"(select coalesce(sum(len(regexp_extract_all(txt, {WORD}))), 0) from turns where speaker = 'Interviewee')"
    lines = {
        "Source documents": "(select count(*) from docs)",
        "Successful documents": "(select count(*) from docs)",
        "Error documents": "0",
        "Parsed speaker turns": "(select count(*) from turns)",
        "Event markers": events,
        "Interviewee turns": "(select count(*) from turns where speaker = 'Interviewee')",
        "Interviewer turns": "(select count(*) from turns where speaker = 'Interviewer')",
        "Interviewee words": words,
        "Documents without interviewee turns": "(select count(*) from docs where id not in (select id from turns where speaker = 'Interviewee'))",
        "Documents with artifacts": "0",
        "Artifacts": "0",
        "Documents with unintelligible markers": "(select count(*) from docs where un > 0)",
        "Unintelligible markers": "(select coalesce(sum(un), 0) from docs)",
    }
    rows = ", ".join(["'# Extraction report'", "''", *[f"'- {k}: ' || {v}::bigint" for k, v in lines.items()]])
    return f"""with {INTERVIEW}, {TURNS}, docs as (select id, len(regexp_extract_all(full_text, '(?i)unintelligible|\\[uninte')) un from norm), r as (select [{rows}] t)
select (generate_subscripts(t, 1) - 1)::int line, unnest(t) "text" from r"""


_CRITERIA = '{"min_support":5,"min_precision":0.65,"min_lift":1.05}'
_VALUE = f"""'{{"words":' || to_json(w)::varchar || ',"phrases":' || to_json(p)::varchar || ',"exclude_patterns":[],"criteria":{_CRITERIA}}}'"""


def rounded(x: str, digits: int) -> str:
    return f"(round(({x}) * {10.0**digits}::double) / {10.0**digits}::double)"


def _status() -> str:
    zero = q(
        (
            "Event token leakage",
            "Bracket event leakage",
            "Speaker label leakage",
            "Punctuation-leading segments",
            "Selected illegal boundaries",
        )
    )
    tests = {
        "Median segment tokens": "v between 12 and 25",
        "Mean segment tokens": "v between 15 and 30",
        "Short segment rate": "v <= 0.25",
        "Long segments > 60 tokens": "v = 0",
    }
    tests |= {"Max tokens": "v <= 60", "Max segments per record": "v <= 80", "Selected semi-legal boundary rate": "v <= 0.15"}
    ladder = " ".join(f"when metric = {lit(m)} then case when {t} then 'PASS' else 'WARNING' end" for m, t in tests.items())
    other = "max(v) over (partition by pair)"
    return f"""case when metric in ('Segments', 'Boundaries', 'Records', 'Selected boundaries') then 'INFO'
  when pair <> '' then case when count(v) over (partition by pair) < 2 then 'WARNING' when ends_with(metric, ': selected') = (pair = 'Mean transition pressure') then case when v = {other} and v > min(v) over (partition by pair) then 'PASS' else 'WARNING' end
    else case when v = min(v) over (partition by pair) and v < {other} then 'PASS' else 'WARNING' end end
  when v is null then 'WARNING' {ladder} when metric in ({zero}) then case when v = 0 then 'PASS' else 'FAIL' end else 'INFO' end"""


def _summary() -> str:
    mean = lambda x, test: rounded(f"sum(cast(round({r4(x)} * 10000) as bigint)) filter (where {test}) / count(*) filter (where {test}) / 10000", 4)
    values = {
        "Segments": "segs", "Boundaries": "bounds", "Records": "recs", "Median segment tokens": "med", "Mean segment tokens": "mean", "Short segments < 8 tokens": "short", "Short segment rate": "rate",
        "Long segments > 60 tokens": "lng", "Max tokens": "mx", "Max segments per record": "per", "Event token leakage": "ev", "Bracket event leakage": "br", "Speaker label leakage": "sp",
        "Punctuation-leading segments": "pu", "Selected boundaries": "chosen", "Selected illegal boundaries": "ill", "Selected semi-legal boundary rate": "0.0", "Mean semantic gravity: selected": "gs",
        "Mean semantic gravity: non-selected": "gn", "Mean transition pressure: selected": "ps", "Mean transition pressure: non-selected": "pn",
    }
    rows = ", ".join(
        f"{{'at': {i}, 'metric': {lit(m)}, 'v': ({v})::double, 'criterion': {lit(qc.CRITERIA[m])}}}"
        for i, (m, v) in enumerate(values.items())
    )
    return f"""one as (select count(*) segs, {rounded("median(n)", 2)} med, {rounded("sum(n) / count(n)", 2)} mean, count(*) filter (where n < 8) short, {rounded("count(*) filter (where n < 8) / count(*)", 3)} rate,
  count(*) filter (where n > 60) lng, max(n) mx, count(*) filter (where contains(txt, '<EVENT>')) ev, count(*) filter (where regexp_matches(txt, '(?i)\\[(?:Pause|Drawing|End of Audio|Unintelligible)')) br,
  count(*) filter (where regexp_matches(txt, {LABEL})) sp, count(*) filter (where regexp_matches(txt, '^\\s*[,.;:!?]')) pu from seg),
two as (select count(*) recs, max(c) per from (select rid, count(*) c from seg group by rid)),
three as (select count(*) bounds, count(*) filter (where picked) chosen, count(*) filter (where picked and reason <> '') ill, {mean("g", "picked")} gs, {mean("g", "not picked")} gn, {mean("p", "picked")} ps, {mean("p", "not picked")} pn from bound),
metrics as (select r.*, regexp_extract(r.metric, '^(Mean .*): (?:non-)?selected$', 1) pair from (select unnest([{rows}]) r from one, two, three)),
judged as (select *, {_status()} status from metrics)
select "at"::int "at", metric "Metric", v "Value", criterion "Criterion", status "Status", case status when 'PASS' then 'Within the suggested range.' when 'FAIL' then 'Must be zero before annotation.'
  when 'WARNING' then 'Missing, or outside the suggested range.' else 'Reported for traceability.' end "Status_Note" from judged"""


def _saturation() -> str:
    cells = " union all ".join(
        f"select '{s}' sig, {r4(x)} v from bound" for s, x in (("C_t", "c"), ("M_t", "m"), ("A_t", "a"), ("R_t", "rr"))
    )
    parts = " union all ".join(
        f"select '{s}' sig, typ = '{C.TYPE_NAMES[s]}' first, k_{x} k from seg"
        for s, x in (("C_t", "c"), ("M_t", "m"), ("A_t", "a"), ("R_t", "rr"))
    )
    return f"""cells as ({cells}), per as (select sig, {rounded("sum(cast(round(v * 10000) as bigint)) / count(v) / 10000", 3)} mean, quantile_cont(v, 0.5) mid, {rounded("quantile_cont(v, 0.9)", 3)} p90,
  {rounded("count(*) filter (where v > 0.8) / count(v)", 3)} high from cells group by sig),
parts2 as ({parts}), own as (select sig, count(*) filter (where first) pri, {rounded("count(*) filter (where first) / count(*)", 3)} prate, count(*) filter (where k / 10000.0::double >= 0.5) pos,
  {rounded("count(*) filter (where k / 10000.0::double >= 0.5) / count(*)", 3)} posrate, {rounded("sum(k) / count(k) / 10000", 3)} ms from parts2 group by sig)
select sig "Signal", mean "Mean", p90 "P90", high "Pct_High", pri "Primary_Segments", prate "Primary_Rate", pos "Positive_Segments", posrate "Positive_Rate", ms "Mean_Segment_Signal", {rounded("mid", 3)} "Median",
mid > 0.75 "Saturated", case when mid > 0.75 or {rounded("mid", 3)} > 0.75 or high > 0.5 or posrate > 0.6 then 'WARNING' else 'PASS' end "Status" from per join own using (sig)"""


ITEMS = f"""dominant as (select *, greatest({r4('c')}, {r4('m')}, {r4('a')}, {r4('rr')}) best from evidence where picked or (cand and con = '')),
items as (select *, case when picked then 'selected' else 'candidate' end source, case when best < 0.20 then 'low_signal' when {r4('c')} = best then 'C_t' when {r4('m')} = best then 'M_t' when {r4('a')} = best then 'A_t' else 'R_t' end dom,
  rid || '__row_' || src || '__text__gap_' || gap item from dominant)"""

ITEM_COLUMNS = f"""item "Annotation_Item_ID", rid "Record_ID", src "Source_Row", 'text' "Source_Column", gap::int "Boundary_Gap", source "Item_Source", source || '_' || dom "Sampling_Stratum", dom "Algorithm_Dominant_Signal",
picked "Algorithm_Selected_Boundary", legality "Boundary_Legality", con "Legality_Reason", reason "Rule_Reason", '' "Spacy_Reason", '' "Spacy_Left_POS", '' "Spacy_Right_POS", '' "Spacy_Left_DEP", '' "Spacy_Right_DEP",
con "Boundary_Constraint_Reason", '[[CANDIDATE_BOUNDARY]] marks the candidate break; it is not transcript text.' "Boundary_Marker_Explanation", replace(context, '<BOUNDARY>', '[[CANDIDATE_BOUNDARY]]') "Boundary_Context",
{r4('c')} "Alg_C_t", {r4('m')} "Alg_M_t", {r4('a')} "Alg_A_t", {r4('rr')} "Alg_R_t", g "Semantic_Gravity", {r4('t - g')} "Boundary_Margin\""""


CLEAN = "coalesce(text, '')"
for a, b in (*T.CONTROLS, ("Â", ""), *T.SEQUENCES):
    CLEAN = f"replace({CLEAN}, {lit(a) if a.isprintable() else f'chr({ord(a)})'}, {lit(b)})"
for a, b in T.REPAIRS:
    CLEAN = f"regexp_replace({CLEAN}, {lit(a.replace('(?iU)', '(?i)').replace('(?U)', ''))}, {lit(b.replace('$', chr(92)))}, 'g')"
CLEAN = f"trim({CLEAN})"
ARTIFACTS = " + ".join(
    [
        f"len(regexp_extract_all(coalesce(text, ''), '(?:{T.LOST})+'))",
        f"len(regexp_extract_all(coalesce(text, ''), {LABEL}))",
        *[
            f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), {lit(m) if m.isprintable() else f'chr({ord(m)})'}, ''))) // {len(m)}"
            for m in ["\x14", "\x19", "\x1c", "\x1d", "\xfd", "\xfd", "Â", *(s for s, _ in T.SEQUENCES)]
        ],
    ]
)

INTERVIEW = """iv as (select conv_id, upper('et_' || conv_id) id, string_agg(case when role = 'user' then 'Interviewee: ' else 'Interviewer: ' end || coalesce(text, '') || case when turn % 3 = 0 then ' [Pause 3s] ' else chr(10) end, '' order by turn) raw
  from conversations group by conv_id),
norm as (select id, trim(regexp_replace(regexp_replace(raw, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(10)) full_text from iv)"""
TURNS = f"""bodies as (select id, unnest(regexp_extract_all(full_text, {SPEAKER}, 1)) who, unnest(string_split_regex(full_text, {lit(T.SPEAKER.replace("(Interviewer|Interviewee)", "(?:Interviewer|Interviewee)"))})[2:]) body,
  generate_subscripts(regexp_extract_all(full_text, {SPEAKER}, 1), 1) nr from norm),
stripped as (select id, nr, who, trim(body, ' ' || chr(10)) raw, trim(regexp_replace(regexp_replace(trim(body), {lit(T.EVENT_MARK)}, ' <EVENT> ', 'g'), '\\s+', ' ', 'g')) txt from bodies),
turns as (select id, row_number() over (partition by id order by nr) turn_index, upper(who[1]) || lower(who[2:]) speaker, trim(txt) txt, raw from stripped where trim(txt) <> '')"""

LABELS = """lab as (select d.doc_id, quality, toxic, text from labels join documents d on labels.doc_id = d.doc_id),
lab2 as (select 'd_' || doc_id item, 'r1' who, quality * 2 st, quality c, quality m, case when doc_id % 5 > 0 then toxic end a, quality r from lab
  union all select 'd_' || doc_id, 'r2', (1 - toxic) * 2 + toxic, 1 - toxic, quality, case when doc_id % 5 > 0 then toxic end, null from lab)"""


CUES = f"""texts as (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), {CUE}), lambda x: replace(lower(x), '’', '''')) t from lab),
grams as (select distinct doc_id, g from (select doc_id, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) g from texts)),
sg as ({" union all ".join(f"select '{s}' sig, item, {c} v from lab2 where {c} is not null" for s, c in (("C_t", "c"), ("M_t", "m"), ("A_t", "a"), ("R_t", "r")))}),
by_item as (select sig, item, count(*) n, sum(v) p from sg group by sig, item), tot as (select sig, sum(n) n, sum(p) p from by_item group by sig),
per as (select sig, g, sum(n) n, sum(p) p from by_item join grams on item = 'd_' || doc_id group by sig, g having sum(n) >= 5),
cues as (select per.sig "Signal", g "Cue", per.n::bigint "Support", per.p::bigint "Positive_With_Cue", round(per.p / per.n, 3) "Precision", round(coalesce(per.p / nullif(tot.p, 0), 0.0), 3) "Recall",
  round((per.p / per.n) / nullif(tot.p / tot.n, 0), 3) "Lift" from per join tot using (sig) where per.p / per.n >= 0.65 and (tot.p = 0 or (per.p / per.n) / (tot.p / tot.n) >= 1.05))"""


def _cells() -> str:
    return " union all ".join(
        f"select '{s}' sig, item, who, {c} v from lab2 where {c} is not null"
        for s, c in (("Boundary_Strength_0_3", "st"), ("C_t", "c"), ("M_t", "m"), ("A_t", "a"), ("R_t", "r"))
    )


def _gate() -> str:
    def has(words) -> str:
        return f"list_has_any(ws, [{q(words)}])"

    def arr(k: str) -> str:
        return "[" + ", ".join(f"{x}::double" for x in frames.DEMO_GATES[k]) + "]"

    return f"case when {has(GATE_WORDS['A'])} then {arr('A')} when {has(GATE_WORDS['M'])} then {arr('M')} when {has(GATE_WORDS['T'])} then {arr('T')} else {arr('S')} end"


def frame_sql(task_words, text: str = "coalesce(text, '')") -> str:
    return f"""ft as (select conv_id || '_' || turn id, list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> '') wl from conversations),
fr as (select id, wl, len(wl) n, unnest(range(0, len(wl) - 4)) i from ft where len(wl) >= 5),
fw as (select *, list_filter(string_split_regex(regexp_replace(lower(array_to_string(wl[i + 1 : i + 5], ' ')), '[^a-zA-Z\\s]', '', 'g'), '\\s+'), lambda x: x <> '') ws from fr),
fg as (select *, {_gate()} gt, case when list_has_any(ws, [{q(task_words)}]) then 1.0::double else 0.0::double end tk from fw),
fs as (select *, round(gt[4] * (1.0::double + 0.5::double * tk) - (gt[1] * 0.1::double + gt[2] * 0.8::double + gt[3] * 1.2::double), 6) grav from fg),
fl as (select *, grav < 0.35 low, lag(grav < 0.35) over (partition by id order by i) was from fs),
fc as (select id, i, least(case when low then i + 4 else i end, n) cut from fl where was is not null and low <> was),
fb as (select id, cut from (select *, coalesce(max(cut) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0) bey from fc) where cut > bey),
fm as (select id, cut pt from fb union select id, 0 from fr union select id, n from fr),
fu as (select id, pt a, lead(pt) over (partition by id order by pt) z, row_number() over (partition by id order by pt) unit from fm)"""


def _q_matrix() -> str:
    dims = ["gS", "gM", "gA", "gT"]
    gates = ", ".join(f"avg(gt[{k + 1}]) {d}" for k, d in enumerate(dims))
    best = "greatest(" + ", ".join(f"round({d}, 9)" for d in dims) + ")"
    dim = "case " + " ".join(f"when round({d}, 9) = {best} then '{d[1]}'" for d in dims) + " else 'None' end"
    clean = "regexp_replace(lower(array_to_string(words[j + 1 : j + 5], ' ')), '[^a-zA-Z\\s]', '', 'g')"
    return f"""with {frame_sql(frames.T_WORDS, "replace(coalesce(text, ''), ' | ', ' ')")},
kept as (select fu.id, row_number() over (partition by fu.id order by unit) edu, wl[a + 1 : z] words from fu join ft using (id) where z - a >= 3),
uf as (select id, edu, list_filter(string_split_regex({clean}, '\\s+'), lambda x: x <> '') ws from (select *, unnest(range(0, len(words) - 4)) j from kept where len(words) >= 5)),
ug as (select id, edu, {gates} from (select *, {_gate()} gt from uf) group by id, edu),
un as (select kept.id, kept.edu, array_to_string(words, ' ') txt, {", ".join(dims)}, {dim} dim from kept left join ug on kept.id = ug.id and kept.edu = ug.edu)
select id "Student_ID", edu::int "EDU_Index", txt "EDU_Text", dim "Dominant_Dim", {", ".join(f"(dim = '{d[1]}')::int \"Q_{d[1]}\"" for d in dims)}, {", ".join(f"round(round(coalesce({d}, 0.0), 9) * 10000.0::double) / 10000.0::double \"Weight_{d[1]}\"" for d in dims)} from un"""


_SILVER = "list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-zA-Z\\s]', '', 'g'), '\\s+'), lambda x: x <> '')"
_WEIGHTS = [[((i * 7 + k * 3) % 11 - 5) / 10.0 for i in range(64)] for k in range(4)]
_Z = ", ".join(
    f"list_inner_product(cast(embedding as double[]), [{', '.join(f'{x}::double' for x in row)}]) + {b}::double z{k}"
    for k, (row, b) in enumerate(zip(_WEIGHTS, (0.1, 0.0, -0.1, 0.2), strict=True))
)

ORACLES = {
    "clean_artifacts": f"select doc_id, md5({CLEAN}) cleaned_md5, cast({ARTIFACTS} as bigint) artifacts from documents",
    "tokenize_counts": f"select doc_id, len(t)::int n_tokens, len(list_filter(t, lambda x: x not in ({PUNCT}, '<EVENT>')))::int n_words, md5(array_to_string(t, ' ')) tokens_md5, md5({DETOK.format('t')}) detokenized_md5 from (select doc_id, regexp_extract_all(coalesce(text, ''), {TOKEN}) t from documents)",
    "truncation_flags": f"""select doc_id, coalesce(regexp_matches(rtrim(text), '[\\p{{L}}\\p{{N}}]$') and (lw in ({q(C.TRUNCATED)}) or (length(lw) <= 4 and lw not in ({q(C.COMMON_SHORT)}))), false) truncated
from (select doc_id, text, lower(list_filter(regexp_extract_all(coalesce(text, ''), {TOKEN}), lambda x: x not in ({PUNCT}))[-1]) lw from documents)""",
    "corpus_turns": f"""with {INTERVIEW}, {TURNS} select id "ID", turn_index::int "Turn_Index", speaker "Speaker", md5(txt) turn_md5, len(regexp_extract_all(txt, {WORD}))::bigint "Word_Count",
len(regexp_extract_all(raw, {lit(T.EVENT_MARK)}))::int "Event_Count", len(list_filter(regexp_extract_all(raw, {lit(T.EVENT_MARK)}), lambda x: contains(lower(x), 'unintelligible')))::int "Unintelligible_Count", len(regexp_extract_all(txt, {lit(T.TIMESTAMP)}))::int "Timestamp_Count" from turns""",
    "corpus_documents": f"""with {INTERVIEW}, {TURNS} select norm.id "ID", length(full_text)::int "Text_Chars", len(regexp_extract_all(full_text, {WORD}))::bigint "Text_Words", coalesce(n, 0) "Turn_Count", coalesce(ee, 0) "Interviewee_Turns", coalesce(er, 0) "Interviewer_Turns",
coalesce(words, 0)::bigint "Interviewee_Words", len(regexp_extract_all(full_text, '(?i)unintelligible|\\[uninte'))::int "Unintelligible_Count", len(regexp_extract_all(full_text, {lit(T.TIMESTAMP)}))::int "Timestamp_Count", 0::bigint "Artifact_Count", md5(coalesce(resp, '')) response_md5
from norm left join (select id, count(*) n, count(*) filter (where speaker = 'Interviewee') ee, count(*) filter (where speaker = 'Interviewer') er, sum(len(regexp_extract_all(txt, {WORD}))) filter (where speaker = 'Interviewee') words,
string_agg(txt, ' | ' order by turn_index) filter (where speaker = 'Interviewee') resp from turns group by id) x on norm.id = x.id""",
    "corpus_events": f"""with {INTERVIEW}, {TURNS}, ev as (select *, regexp_extract_all(raw, {lit(T.EVENT_MARK)}) marks, string_split_regex(raw, {lit(T.EVENT_MARK)}) bits from turns),
eo as (select *, unnest(range(1, len(marks) + 1)) i from ev),
ep as (select *, trim(regexp_extract(marks[i], '^\\[([A-Za-z ]+)', 1)) kd, (coalesce(list_sum(list_transform(bits[1 : i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(marks[1 : i - 1], lambda x: length(x))), 0))::int beg from eo)
select id "ID", turn_index::int "Turn_Index", speaker "Speaker", i::int "Event_Index", case when kd = '' then 'Event' else upper(kd[1]) || lower(kd[2:]) end "Event_Type", marks[i] "Event_Text", beg "Char_Start", (beg + length(marks[i]))::int "Char_End" from ep""",
    "legacy_turns": f"""with {INTERVIEW}, said as (select conv_id, list_filter(list_transform(list_filter(string_split_regex(raw, '(?i)Interviewer:'), lambda x: regexp_matches(x, '(?i)Interviewee:')),
  lambda x: trim(regexp_replace(regexp_extract(x, '(?is)Interviewee:\\s*(.*)', 1), '\\s+', ' ', 'g'))), lambda x: x <> '') l from iv)
select 'et-' || conv_id stem, len(l)::int "Total_Turns", md5(array_to_string(l, ' | ')) response_md5 from said""",
    "boundary_evidence": f"""{WITH_VALLEY}, {selection(CONFIG.max_segment_tokens)}, {CONTEXT} select {EVIDENCE} from evidence""",
    "forced_split": f"""{WITH_VALLEY}, {selection(25)} select rid "Record_ID", gap::int gap, g semantic_gravity from bound where f""",
    "segments": f"""{WITH_VALLEY}, {segmentation(CONFIG.max_segment_tokens, CONFIG.max_segments_per_record)} select {segment_columns()} from seg""",
    "cap_merge": f"""{WITH_VALLEY}, {segmentation(LOW.max_segment_tokens, LOW.max_segments_per_record)} select {segment_columns()} from seg""",
    "qc_summary": f"""{WITH_VALLEY}, {segmentation(CONFIG.max_segment_tokens, CONFIG.max_segments_per_record)}, {_summary()}""",
    "qc_signals": f"""{WITH_VALLEY}, {segmentation(CONFIG.max_segment_tokens, CONFIG.max_segments_per_record)}, {_saturation()}""",
    "boundary_items": f"""{WITH_VALLEY}, {selection(CONFIG.max_segment_tokens)}, {CONTEXT}, {ITEMS} select {ITEM_COLUMNS} from items""",
    "segment_context": f"""{WITH_VALLEY}, {segmentation(CONFIG.max_segment_tokens, CONFIG.max_segments_per_record)}, {CONTEXT}, {ITEMS},
prior as (select *, coalesce(lag(txt) over (partition by rid, src order by idx), '') prev from seg),
lefts as (select i.item, i.rid, i.src, i.gap, p.txt lt, p.z lz, p.prev from items i asof left join prior p on i.rid = p.rid and i.src = p.src and i.gap >= p.z),
rights as (select l.*, p.txt rt from lefts l asof left join prior p on l.rid = p.rid and l.src = p.src and l.gap <= p.a)
select item "Annotation_Item_ID", case when lz = gap then prev else '' end "Previous_Segment", coalesce(lt, '') "Left_Segment", coalesce(rt, '') "Right_Segment" from rights""",
    "q_matrix": _q_matrix(),
    "tagged_words": f"""with recursive {TRANSCRIPTS}, {TAGGER} select rid "Record_ID", chunk::int chunk, i::int "at", w word, tag from pt""",
    "parser_legality": f"""with recursive {TRANSCRIPTS}, {PARSER} select rid "Record_ID", gap::int gap, leg spacy_legality, why_text spacy_legality_reason, lt spacy_left_pos, rd spacy_right_dep,
same spacy_same_sentence, sb spacy_sentence_boundary, nc spacy_inside_noun_chunk from parser""",
    "legality_modes": f"""{WITH_GAPS}, {PARSER}, {MODES} select rid "Record_ID", gap::int gap, bl boundary_legality,
array_to_string(list_filter([nullif(con, ''), nullif(why_text, '')], lambda x: x is not null), ';') legality_reason,
con constraint_reason, pen legality_penalty, bst sentence_boundary_boost, {r4("raw + pen - bst")} semantic_gravity from pb""",
    "label_migration": """select doc_id, case when doc_id % 4 = 3 then null when quality = 0 then '0' when quality = 1 then '2' end "Boundary_Strength_0_3" from labels""",
    "label_validation": f"""with {LABELS}, x as (select item || '__' || who id, (item[3:])::bigint * 2 + (who = 'r2')::int n, * from lab2),
y as (select id, case when n % 11 = 0 then '4' when n % 11 = 1 then ' ' else st::varchar end st, case when n % 7 = 0 then 'maybe' when m = 1 then 'yes' else 'no' end m,
  case when n % 5 = 0 then 'mixed' when n % 13 = 0 then 'other' else '' end kind from x)
select id "Annotation_ID", st "Boundary_Strength_0_3", m "Human_M_t", kind "Human_Primary_Type" from y where st = '4' or m = 'maybe' or kind = 'other'""",
    "review_upsert": f"""with {LABELS}, x as (select item || '__' || who id, ((item[3:])::bigint * 2 + (who = 'r2')::int) % 3 n, * from lab2)
select id "Annotation_ID", case when n = 0 then '3' else st::varchar end "Boundary_Strength_0_3", case when n = 0 then '0' else c::varchar end "Human_C_t",
case when m = 1 then 'yes' else 'no' end "Human_M_t" from x""",
    "annotator_rows": f"""with {LABELS} select item || '__' || who "Annotation_ID",
case when st is null or c is null or m is null or a is null or r is null then 'pending' else 'complete' end "Review_Status" from lab2 where who = 'r2'""",
    "label_cells": f"""select doc_id, case when trim(c) in ('0', '0.0', 'False', 'false') then '0' when trim(c) in ('1', '1.0', 'True', 'true') then '1' when trim(c) <> '' then trim(c) end choice,
case when lower(trim(c)) in ('1', '1.0', 'true', 'yes', 'y') then 1 when lower(trim(c)) in ('0', '0.0', 'false', 'no', 'n') then 0 end "binary",
case when try_cast(trim(c) as double) in (0, 1, 2, 3) then try_cast(trim(c) as double)::int end strength,
lower(c) in ('true', '1', 'yes', 'y') "boolean" from (select doc_id, {_CELL} c from labels)""",
    "gate_training_set": f"""with c as (select 'Interviewee: ' || text t from conversations union all select case when turn % 2 = 0 then role end from conversations),
x as (select trim(replace(t, 'Interviewee:', '')) text from c where t is not null), y as (select text, {_SILVER} w from x where length(text) >= 5)
select case when list_has_any(w, [{q(frames.A_WORDS)}]) then 2 when list_has_any(w, [{q(frames.M_WORDS)}]) then 1 when list_has_any(w, [{q(frames.T_WORDS)}]) then 3 else 0 end "label",
count(*) texts, sum(length(text))::bigint chars from y group by 1""",
    "cleaned_table": f"""select doc_id, md5({CLEAN}) text_md5, source, (select sum({ARTIFACTS}) + count(*) from documents)::bigint artifacts from documents""",
    "vocabulary_json": f"""with {LABELS}, {CUES},
top as (select *, row_number() over (partition by "Signal" order by "Precision" desc, "Lift" desc nulls last, "Support" desc, "Cue") rk from cues),
lists as (select s, coalesce(list("Cue" order by rk) filter (where not contains("Cue", ' ')), []) w, coalesce(list("Cue" order by rk) filter (where contains("Cue", ' ')), []) p
  from (values ('C_t'), ('M_t'), ('A_t'), ('R_t')) v(s) left join (select * from top where rk <= 20) t on s = "Signal" group by s)
select '{{' || string_agg('"' || s || '":' || {_VALUE}, ',' order by s) || '}}' vocabulary from lists""",
    "corpus_report": _report(),
    "document_ids": f"""with x as (select doc_id, 'ete21-' || lpad(doc_id::varchar, 4, '0') stem, coalesce(text, '') t from documents),
y as (select *, t || case when doc_id % 3 = 0 then ' see ' || stem else '' end || case when doc_id % 2 = 0 then chr(2) else '' end s from x)
select doc_id, upper(replace(stem, '-', '_')) id, upper(replace(coalesce(regexp_extract(s, {lit(T.MENTIONED)}, 1), ''), '-', '_')) mentioned,
  (len(regexp_extract_all(s, {lit(f"(?:{T.LOST})+")})) + len(regexp_extract_all(s, {lit(T.CONTROL_CHARS)})) + length(s) - length(replace(s, '�', '')))::bigint artifacts,
  len(regexp_extract_all(s, {WORD}))::bigint words from y""",
    "source_rows": """select n_nationkey::varchar "Record_ID", row_number() over (order by n_nationkey) + 1 "Source_Row", 'n_name' "Source_Column", md5(n_name) text_md5 from nation""",
    "workbook_sheets": """select c_custkey::bigint c_custkey, c_name, c_acctbal, c_mktsegment, n_nationkey::bigint n_nationkey, n_name
from customer left join nation on c_nationkey = n_nationkey""",
    "run_facts": f"""select unnest([{", ".join(lit(k) for k in ("rows", *asdict(CONFIG)))}]) "Field",
unnest([(select count(*) from conversations)::varchar, {", ".join(lit(str(v)) for v in asdict(CONFIG).values())}]) "Value\"""",
    "gap_density_signals": f"""{WITH_GAPS} select rid "Record_ID", gap::int gap, {r4('dt')} task_density, {r4('m')} metacognitive_reset, {r4('a')} affective_friction, {r4('rr')} structural_break from scored""",
    "gap_continuity": f"""{WITH_GAPS} select rid "Record_ID", gap::int gap, {r4('s')} semantic_continuity, {r4('dp')} semantic_drop_component, {r4('sh')} cognitive_cue_shift, {r4('ec')} cognitive_cue_evidence from scored""",
    "lexical_continuity": f"""with recursive {TRANSCRIPTS}, {FLAGS}, {BLOCKS}, {signals(LEXICAL, "sided")}
select rid "Record_ID", gap::int gap, {r4('s')} semantic_continuity, g semantic_gravity from scored""",
    "encoded_continuity": f"""with recursive {TRANSCRIPTS}, {FLAGS}, {VECTORS}, {signals("cosine", "sided")}
select rid "Record_ID", gap::int gap, {r4('s')} semantic_continuity, g semantic_gravity from scored""",
    "gap_pressure_gravity": f"""{WITH_GAPS} select rid "Record_ID", gap::int gap, {r4('c')} cognitive_transition, {r4('p')} transition_pressure, {r4('raw')} raw_semantic_gravity, g semantic_gravity from scored""",
    "gap_legality_rules": f"""{WITH_GAPS} select rid "Record_ID", gap::int gap, left_token, token right_token, reason rule_constraint_reason, case when reason <> '' then 'illegal' else 'legal' end boundary_legality, boost sentence_boundary_boost from scored""",
    "valley_candidates": f"""{WITH_VALLEY} select rid "Record_ID", gap::int gap, cand candidate_boundary, reason <> '' constraint_blocked from valley""",
    "boundary_select": f"""{WITH_VALLEY} select rid "Record_ID", gap::int gap, g semantic_gravity from valley join chosen using (rid, src, chunk, pos)""",
    "segment_types": f"""{WITH_VALLEY}, marked as (select tok.*, sum(case when chosen.pos is not null then 1 else 0 end) over (partition by tok.rid, tok.src, tok.chunk order by tok.pos) seg, chosen.pos is not null cut from tok left join chosen using (rid, src, chunk, pos)),
body as (select rid, src, chunk, seg, any_value(off) off, min(pos) a, max(pos) + 1 z, list(token order by pos) words from marked group by all),
proof as (select rid, src, chunk, unnest(case when cut then [seg, seg - 1] else [seg] end) seg, c, m, a, rr, g from marked join scored using (rid, src, chunk, pos)),
means as (select rid, src, chunk, seg, {", ".join(f"sum(cast(round({r4(x)} * 10000) as bigint))::double / count(*) / 10000 m{x}, (sign(sum(cast(round({r4(x)} * 10000) as bigint))) * ((2 * abs(sum(cast(round({r4(x)} * 10000) as bigint))) + count(*)) // (2 * count(*))))::double / 10000 r{x}" for x in ("c", "m", "a", "rr", "g"))} from proof group by all),
best as (select *, list_sort([{{'neg': -mc, 'at': 0, 'nm': 'cognitive'}}, {{'neg': -mm, 'at': 1, 'nm': 'metacognitive'}}, {{'neg': -ma, 'at': 2, 'nm': 'affective'}}, {{'neg': -mrr, 'at': 3, 'nm': 'structural'}}]) o from means)
select rid "Record_ID", row_number() over (partition by rid, src order by chunk, seg)::int "Segment_Index", (off + a)::int "Token_Start", (off + z)::int "Token_End", (z - a)::int "Token_Count", md5({DETOK.format("words")}) text_md5,
case when -o[1].neg < 0.20 then 'low_signal' when o[2].neg <= -0.30 and greatest(0.0, -o[1].neg + o[2].neg) < 0.10 then 'mixed_' || o[1].nm || '_' || o[2].nm else o[1].nm end "Segment_Type",
rc "Mean_C_t", rm "Mean_M_t", ra "Mean_A_t", rrr "Mean_R_t", rg "Mean_Semantic_Gravity" from body join best using (rid, src, chunk, seg)""",
    "qc_token_lengths": f"""with s as (select conv_id || '_' || turn rid, coalesce(text, '') text, len(regexp_extract_all(coalesce(text, ''), {TOKEN})) n from conversations),
x as (select count(*)::double segs, round(median(n), 2) med, round(sum(n) / count(*), 2) mean, count(*) filter (where n < 8)::double short, round(count(*) filter (where n < 8) / count(*), 3) rate, count(*) filter (where n > 60)::double lng, max(n)::double mx,
 count(*) filter (where contains(text, '<EVENT>'))::double ev, count(*) filter (where regexp_matches(text, '(?i)\\[(?:Pause|Drawing|End of Audio|Unintelligible)'))::double br, count(*) filter (where regexp_matches(text, {LABEL}))::double sp, count(*) filter (where regexp_matches(text, '^\\s*[,.;:!?]'))::double pu, count(*) filter (where n > 50)::double sel from s),
y as (select count(*)::double rec, max(c)::double per from (select rid, count(*) c from s group by rid))
select unnest(['Segments', 'Boundaries', 'Records', 'Median segment tokens', 'Mean segment tokens', 'Short segments < 8 tokens', 'Short segment rate', 'Long segments > 60 tokens', 'Max tokens', 'Max segments per record', 'Event token leakage', 'Bracket event leakage', 'Speaker label leakage', 'Punctuation-leading segments', 'Selected boundaries']) "Metric",
unnest([segs, segs, rec, med, mean, short, rate, lng, mx, per, ev, br, sp, pu, sel]) "Value",
unnest(['INFO', 'INFO', 'INFO', case when med between 12 and 25 then 'PASS' else 'WARNING' end, case when mean between 15 and 30 then 'PASS' else 'WARNING' end, 'INFO', case when rate <= 0.25 then 'PASS' else 'WARNING' end, case when lng = 0 then 'PASS' else 'WARNING' end, case when mx <= 60 then 'PASS' else 'WARNING' end, case when per <= 80 then 'PASS' else 'WARNING' end,
 case when ev = 0 then 'PASS' else 'FAIL' end, case when br = 0 then 'PASS' else 'FAIL' end, case when sp = 0 then 'PASS' else 'FAIL' end, case when pu = 0 then 'PASS' else 'FAIL' end, 'INFO']) "Status" from x, y""",
    "stratified_sample": """with i as (select 'd_' || doc_id item, lang || '_' || case when n_chars > 2000 then 'long' else 'short' end st, md5('d_' || doc_id || '#42') d from documents),
x as (select *, row_number() over (partition by st order by d, item) rk, (select greatest(1, 50 // count(distinct st)) from i) quota from i)
select item "Annotation_Item_ID", st "Sampling_Stratum" from x order by rk > quota, d, item limit 50""",
    "template_expand": """select 'd_' || doc_id || '__' || who "Annotation_ID", 'd_' || doc_id "Annotation_Item_ID", who "Annotator_ID", lang || '_' || case when n_chars > 2000 then 'long' else 'short' end "Sampling_Stratum", '' "Notes" from documents, (values ('Ana'), ('Ben'), ('Cy')) a(who)""",
    "turn_context": """with s as (select conv_id, turn, turn * 10 a, turn * 10 + 10 z, md5(text) t, coalesce(lag(md5(text)) over (partition by conv_id order by turn), '') prev from conversations),
i as (select conv_id, a gap from s union all select conv_id, a + 5 from s),
l as (select i.*, s.t lt, s.z, s.prev from i asof left join s on i.conv_id = s.conv_id and i.gap >= s.z),
x as (select l.*, s.t rt from l asof left join s on l.conv_id = s.conv_id and l.gap <= s.a)
select conv_id || '_' || gap "Annotation_Item_ID", case when z = gap then prev else '' end "Previous_Segment", coalesce(lt, '') "Left_Segment", coalesce(rt, '') "Right_Segment" from x""",
    "signal_agreement": f"""with {LABELS}, cells as ({_cells()}), b as (select sig, count(*) n, round(sum(v) / count(v), 3) rate from cells group by sig),
it as (select sig, item, count(*) n, min(v) = max(v) same, min_by(v, who) a, max_by(v, who) b from cells group by sig, item),
mu as (select sig, count(*) n, round(count(*) filter (where same) / count(*), 3) agree from it where n >= 2 group by sig),
mg as (select sig, v, sum(x) na, sum(y) nb from (select sig, a v, 1 x, 0 y from it where n = 2 union all select sig, b, 0, 1 from it where n = 2) group by sig, v),
ch as (select sig, sum(na * nb) x from mg group by sig),
ka as (select sig, case when x = n * n then case when same = n then 1.0 end else (n * same - x) / (n * n - x) end k from (select it.sig, count(*)::bigint n, count(*) filter (where a = b)::bigint same, any_value(x)::bigint x from it join ch using (sig) where n = 2 group by it.sig))
select b.sig "Signal", b.n "Completed_Labels", rate "Positive_Rate", coalesce(mu.n, 0) "Multi_Annotated_Items", agree "Exact_Agreement", round(k, 3) "Cohen_Kappa" from b left join mu using (sig) left join ka using (sig)""",
    "item_agreement": f"""with {LABELS} select item "Annotation_Item_ID", count(distinct who) "Annotator_Count", string_agg(st::varchar, ', ' order by who) "Boundary_Strength_Values", min(st) <> max(st) "Boundary_Strength_Disagreement",
{", ".join(f'coalesce(sum({c}), 0)::bigint "{s}_Positive_Count", coalesce(min({c}) <> max({c}), false) "{s}_Disagreement"' for s, c in (("C_t", "c"), ("M_t", "m"), ("A_t", "a"), ("R_t", "r")))} from lab2 group by item""",
    "disagreement_items": f"""with {LABELS} select item "Annotation_Item_ID", count(distinct who) "Annotator_Count", string_agg(st::varchar, ', ' order by who) "Boundary_Strength_Values", min(c) <> max(c) "C_t_Disagreement", min(item || '__' || who) "First_Annotation"
from lab2 group by item having min(st) <> max(st) or min(c) <> max(c) or min(m) <> max(m) or coalesce(min(a) <> max(a), false) or coalesce(min(r) <> max(r), false)""",
    "kappa": """with n as (select count(*) n, count(*) filter (where quality = 1 - toxic) same, count(*) filter (where quality = 1) q1, count(*) filter (where toxic = 0) t1 from labels where quality is not null and toxic is not null),
x as (select *, q1 * t1 + (n - q1) * (n - t1) x from n) select 'all' g, round(case when x = n * n then case when same = n then 1.0 end else (n * same - x) / (n * n - x) end, 6) kappa from x""",
    "cue_association": f"""with {LABELS}, {CUES} select * from cues""",
    "recommended_vocab": f"""with {LABELS}, {CUES}, top as (select *, row_number() over (partition by "Signal" order by "Precision" desc, "Lift" desc nulls last, "Support" desc, "Cue") rk from cues)
select s "Signal", coalesce(string_agg("Cue", ', ' order by rk) filter (where not contains("Cue", ' ')), '') "Recommended_Words", coalesce(string_agg("Cue", ', ' order by rk) filter (where contains("Cue", ' ')), '') "Recommended_Phrases"
from (values ('C_t'), ('M_t'), ('A_t'), ('R_t')) v(s) left join (select * from top where rk <= 50) t on s = "Signal" group by s""",
    "review_progress": f"""with {LABELS} select count(*) filter (where st is not null and c is not null and m is not null and a is not null and r is not null) "Completed", count(*) "Total",
round(100.0 * count(*) filter (where st is not null and c is not null and m is not null and a is not null and r is not null) / nullif(count(*), 0), 1)::double "Percent" from lab2""",
    "silver_label": f"""select conv_id || '_' || turn id, case when list_has_any(w, [{q(frames.A_WORDS)}]) then 2 when list_has_any(w, [{q(frames.M_WORDS)}]) then 1 when list_has_any(w, [{q(frames.T_WORDS)}]) then 3 else 0 end "label",
case when list_has_any(w, [{q(frames.T_WORDS)}]) then 1.0::double else 0.0::double end has_task from (select *, {_SILVER} w from conversations)""",
    "sliding_frames": """select id, count(*) n_frames, max(i)::int "last", md5(string_agg(f, '|' order by i)) frames_md5 from (select id, unnest(range(0, len(wl) - 4, 2)) // 2 i, array_to_string(wl[unnest(range(0, len(wl) - 4, 2)) + 1 : unnest(range(0, len(wl) - 4, 2)) + 5], ' ') f
from (select conv_id || '_' || turn id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') wl from conversations) where len(wl) >= 5) group by id""",
    "frame_units": f"""with {frame_sql(GATE_WORDS["T"])} select fu.id, unit::int unit, a::int a, z::int z, md5(array_to_string(wl[a + 1 : z], ' ')) text_md5 from fu join ft using (id) where z is not null""",
    "embedding_gate": f"""with z as (select vec_id, {_Z} from embeddings), e as (select vec_id, exp(z0 - greatest(z0, z1, z2, z3)) a, exp(z1 - greatest(z0, z1, z2, z3)) b, exp(z2 - greatest(z0, z1, z2, z3)) c, exp(z3 - greatest(z0, z1, z2, z3)) d from z)
select vec_id, round(a / (a + b + c + d), 4) "gS", round(b / (a + b + c + d), 4) "gM", round(c / (a + b + c + d), 4) "gA", round(d / (a + b + c + d), 4) "gT" from e""",
    "cosine_continuity": """with e as (select vec_id, cast(embedding as double[]) x, lead(cast(embedding as double[])) over (partition by label order by vec_id) y from embeddings)
select vec_id, round(greatest(0.0, least(1.0, (list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))) + 1.0) / 2.0))::double, 4) continuity from e where y is not null""",
    "event_history": "select event_id id, user_id, event_type from events order by event_id desc limit 100",
    "latest_artifact": "select user_id, max(event_id) event_id, max_by(event_type, event_id) event_type, max_by(value, event_id) as value from events group by user_id",
    "column_inference": """with c as (select conv_id || '_' || turn rid, turn::bigint src, unnest([{'k': 'Response 1', 't': turn::varchar}, {'k': 'Choice', 't': role},
    {'k': 'item 2', 't': text}, {'k': 'Item 10', 't': upper(role)}, {'k': 'Remarks', 't': role}]) x from conversations)
select rid "Record_ID", src "Source_Row", x.k "Source_Column", md5(x.t) text_md5 from c where regexp_matches(x.k, '(?i)^Item\\s*\\d+$')""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
