"""SQL counterparts for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from hearthpanel.llm import licenses, quality_rules, span_dedup

UPPER, LOWER = licenses.UPPER, licenses.LOWER


def _jaccard_sql(width: int, percent: int) -> str:
    """Links of shingle sets and what they reach."""
    return rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, case when len(w) < {width} then w else list_slice(w, i, i + {width - 1}) end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= {percent} * (x.n + y.n - k)),
reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, coalesce(max(n), 0) as n_shingles, min(other) as component_id, d.doc_id = min(other) as kept
from documents d join reach r on r.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id group by d.doc_id"""


NEAR_DEDUP, PARTITION_JOIN = _jaccard_sql(5, 75), _jaccard_sql(4, 85)

# RE2 has no possessive repeats; where a token, a gap and a row of signs cannot give anything back, greedy ones match alike.
# Nor does it look behind: a word that does not end in some characters is written out.
_ENDS, _PLAIN = span_dedup.ENDINGS, f"[^{span_dedup.SPACE}.!?"
_PIECE = span_dedup.PIECE.replace(f"{_PLAIN}]++(?<![{_ENDS}])", f"{_PLAIN}]*{_PLAIN}{_ENDS}]")
for _possessive, _greedy in (("++", "+"), ("*+", "*"), ("}+", "}"), ("?+", "?")):
    _PIECE = _PIECE.replace(_possessive, _greedy)

SPAN_DEDUP = rf"""
with pieces as (select doc_id, text, regexp_extract_all(text, '{_PIECE}') as p from documents),
each_piece as (select doc_id, unnest(p) as piece, unnest(range(0, len(p))) as pos from pieces),
sentences as (select doc_id, pos, lower(trim(regexp_replace(piece, '\s+', ' ', 'g'))) as wording from each_piece),
worded as (select *, row_number() over (partition by doc_id order by pos) as k from sentences where regexp_matches(wording, '[^.!? ]')),
runs as (select a.doc_id, a.pos as low, c.pos as high, [a.wording, b.wording, c.wording] as run
         from worded a join worded b on b.doc_id = a.doc_id and b.k = a.k + 1 join worded c on c.doc_id = a.doc_id and c.k = a.k + 2),
later as (select doc_id, low, high from runs
          qualify row_number() over (partition by run order by doc_id, low) > 1),
gone as (select distinct doc_id, unnest(range(low, high + 1)) as pos from later),
kept as (select e.doc_id, string_agg(e.piece, '' order by e.pos) as text from each_piece e
         where not exists (select 1 from gone g where g.doc_id = e.doc_id and g.pos = e.pos) group by e.doc_id),
counts as (select doc_id, count(*) as n from worded group by doc_id),
removed as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, coalesce(c.n, 0) as n_sentences, coalesce(r.n, 0) as n_removed,
       case when d.text is null then null else coalesce(k.text, '') end as text
from documents d left join counts c on c.doc_id = d.doc_id left join removed r on r.doc_id = d.doc_id
left join kept k on k.doc_id = d.doc_id"""


def _license_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"({quoted(label)}, {quoted(p)}, {len(p.split())})" for p, label in licenses.PHRASES.items())
    pattern = licenses.WORD
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"
    gram, last = licenses.GRAM, licenses.GRAM - 1
    return f"""
with words as (select doc_id, {words} as w from documents),
phrases(label, phrase, n) as (values {phrases}),
starts as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words),
places as (select s.doc_id, p.label, s.i - 1 as pos from starts s join phrases p on list_slice(s.w, s.i, s.i + p.n - 1) = string_split(p.phrase, ' ')),
base as (select doc_id, count(*) as n, min(pos) as low, max(pos) as high, string_agg(distinct label, ',' order by label) as names from places group by doc_id),
templates(template, label, text) as (values {templates}),
split_templates as (select template, label, {words} as w from templates),
grams as (select template, label, len(w) - {last} as grams, i - 1 as place, list_slice(w, i, i + {last}) as gram
          from (select *, unnest(range(1, len(w) - {last} + 1)) as i from split_templates)),
votes as (select s.doc_id, g.template, g.label, g.grams, g.place, s.i - 1 as pos, s.i - 1 - g.place as diagonal
          from (select doc_id, i, list_slice(w, i, i + {last}) as gram from starts where i + {last} <= len(w)) s join grams g on g.gram = s.gram),
lines as (select doc_id, template, label, grams, diagonal, count(*) as votes, min(pos) as low, max(pos) as high from votes group by all),
cut as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= least({licenses.GAP}, greatest(1, floor(grams / 3))) then 0 else 1 end as apart from lines),
grouped as (select *, sum(apart) over (partition by doc_id, template order by diagonal) as span from cut),
spans as (select doc_id, label, grams, least(1.0, sum(votes) / cast(grams as double)) as score, max(high) + {last} - min(low) + 1 as width
          from grouped group by doc_id, template, label, grams, span),
quoted as (select doc_id, label, score from spans where score >= {licenses.LEAST_SCORE}
           and width <= 1.5 * (grams + {last}) + {licenses.GAP}),
every as (select doc_id, string_agg(distinct label, ',' order by label) as labels
          from (select doc_id, label from places union select doc_id, label from quoted) group by doc_id),
best as (select doc_id, max(score) as score from quoted group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(b.n, 0) as n_base, cast(b.low as bigint) as first_word,
       cast(b.high as bigint) as last_word, coalesce(b.names, '') as base_labels, coalesce(e.labels, '') as labels,
       cast(coalesce(t.score, 0.0) as double) as score
from words w left join base b on b.doc_id = w.doc_id left join every e on e.doc_id = w.doc_id left join best t on t.doc_id = w.doc_id"""


LICENSE_SCAN = _license_sql()


def _quality_sql(false_rejection: float = 0.02, risk: float = 0.05) -> str:
    signals, cells = quality_rules.SIGNALS, quality_rules.CELLS
    shares = [("n_symbols", "word_chars"), ("n_exclamations", "word_chars"), ("n_capitals", "word_chars"),
              ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words")]
    columns = ",\n       ".join(f"case when {b} = 0 then 0 else cast(ceil({a} * {cells} / cast({b} as double)) as int) end as {s}"
                               for s, (a, b) in zip(signals, shares))
    labelled = " union all ".join(f"select lang, {i} as signal, {s} as cell from once" for i, s in enumerate(signals))
    rules = " or ".join(f"coalesce(m.{s} > c{i}, false)" for i, s in enumerate(signals))
    cuts = ", ".join(f"max(cell) filter (signal = {i}) as c{i}" for i in range(len(signals)))
    p, run = false_rejection / len(signals), quality_rules.RUN
    return rf"""
with words as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
runs as (select doc_id, i, list_slice(w, i, i + {run - 1}) as r from (select doc_id, w, unnest(range(1, len(w) - {run - 2})) as i from words where len(w) >= {run})),
repeated as (select doc_id, i from runs qualify count(*) over (partition by doc_id, r) > 1),
covered as (select doc_id, count(distinct i + k) as n from repeated, (select unnest(range(0, {run})) as k) group by doc_id),
lines as (select doc_id, line from (select doc_id, unnest(string_split(t, chr(10))) as line from words) where regexp_matches(line, '[^\x20\x09-\x0D]')),
line_counts as (select doc_id, count(*) as n, count(*) - count(distinct line) as again from lines group by doc_id),
counts as (select w.doc_id, w.lang, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
                  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
                  coalesce(l.again, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, coalesce(l.n, 0) as n_lines,
                  length(t) - length(replace(t, '!', '')) as n_exclamations, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) as n_capitals
           from words w left join line_counts l on l.doc_id = w.doc_id left join covered c on c.doc_id = w.doc_id),
measures as (select *, {columns} from counts),
good as (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1),
once as (select m.* from measures m join good g on g.doc_id = m.doc_id),
labelled as ({labelled}),
counted as (select lang, signal, cell, count(*) as n from labelled group by all),
sums as (select *, sum(n) over (partition by lang, signal) as goods, sum(n) over (partition by lang, signal order by cell desc) - n as beyond from counted),
tails as (select *, case when beyond > goods * {p} then 1.0 else list_sum(list_transform(range(0, cast(beyond as bigint) + 1), lambda i: exp(
            lgamma(goods + 1) - lgamma(i + 1) - lgamma(goods - i + 1) + i * ln({p}) + (goods - i) * ln(1 - {p})))) end as tail from sums),
tested as (select *, max(case when tail > {risk} / (select count(*) from (select distinct lang, signal from counted)) then 1 else 0 end)
                     over (partition by lang, signal order by cell desc) as failed from tails),
cutoffs as (select lang, signal, min(cell) as cell from tested where failed = 0 group by lang, signal),
rules as (select lang as stratum, {cuts} from cutoffs group by lang),
judged as (select m.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {rules} as rejected
           from measures m left join rules r on r.stratum is not distinct from m.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or rejected) as kept from judged"""


QUALITY_RULES = _quality_sql()


def _crc32(text: str) -> str:
    """Unsigned crc32 of a column of ASCII digits; `crc_table` must be in scope with its list `t`."""
    bits = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint)"


_CRC_TABLE = """select list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as t"""


def _merkle_levels(name: str, levels: int) -> str:
    """Tables {name}_n1.. of nodes and {name}_s1.. of every row's way up, from {name}_n0 (grp, pos, n, h) and {name}_s0 (id, grp, pos, cur, proof)."""
    out = []
    for k in range(1, levels + 1):
        wide = f"n > {3 ** (k - 1)}"
        out.append(f"""{name}_p{k} as materialized (select grp, pos // 3 as pos, n, coalesce(max(h) filter (pos % 3 = 0), '') as a,
  coalesce(max(h) filter (pos % 3 = 1), '') as b, coalesce(max(h) filter (pos % 3 = 2), '') as c from {name}_n{k - 1} group by all),
{name}_n{k} as materialized (select grp, pos, n, case when {wide} then sha256(a || b || c) else a end as h from {name}_p{k}),
{name}_s{k} as materialized (select s.id, s.grp, s.pos // 3 as pos,
  case when not {wide} then cur when s.pos % 3 = 0 then sha256(cur || b || c) when s.pos % 3 = 1 then sha256(a || cur || c) else sha256(a || b || cur) end as cur,
  case when not {wide} then proof when s.pos % 3 = 0 then proof || b || c when s.pos % 3 = 1 then proof || a || c else proof || a || b end as proof
  from {name}_s{k - 1} s join {name}_p{k} p on p.grp = s.grp and p.pos = s.pos // 3)""")
    return ",\n".join(out)


def _merkle_sql(levels: int = 20) -> str:
    """Levels enough for 3 ** 20 rows."""
    value = lambda c: f"case when {c} is null then '-' else octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar end"
    leaf = lambda text: "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    return f"""
with crc_table as ({_CRC_TABLE}),
leaves as materialized (select row_number() over () as id, doc_id, case when source is null then '' else '=' || source end as grp, {leaf('text')} as h,
  case when {_crc32('doc_id::varchar')} % 2 = 0 then {leaf("replace(text, chr(10), '')")} end as other from documents, crc_table),
low_n0 as materialized (select id, doc_id, grp, h, coalesce(other, h) as cur, count(*) over (partition by grp) as n,
  row_number() over (partition by grp order by doc_id nulls first, h) - 1 as pos from leaves),
low_s0 as (select id, grp, pos, cur, '' as proof from low_n0),
{_merkle_levels('low', levels)},
top_n0 as materialized (select '' as grp, grp as name, h, count(*) over () as n, row_number() over (order by encode(grp)) - 1 as pos from low_n{levels}),
top_s0 as (select s.id, '' as grp, t.pos, s.cur, s.proof from low_s{levels} s join top_n0 t on t.name = s.grp),
{_merkle_levels('top', levels)}
select d.doc_id, d.h as leaf, t.h as subroot, r.h as root, sha256(s.proof) as proof_sha256, s.cur as folded_root, s.cur = r.h as verified
from low_n0 d join top_n0 t on t.name = d.grp join top_s{levels} s on s.id = d.id join top_n{levels} r on true"""


MERKLE = _merkle_sql()
