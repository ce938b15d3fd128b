"""DuckDB SQL for the script and transcript queries."""

from __future__ import annotations

from checks.sql_watch import WS
from stayline.functions import lexicon as lex
from stayline.functions.textcols import DIGIT, filler_pattern
from stayline.plans.views import SPICE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def spiced(col: str) -> str:
    for a, b in SPICE:
        col = f"replace({col}, {lit(a)}, {lit(b)})"
    return col


BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
STRIP = f"'^{WS}+|{WS}+$'"

DOCS = f"scripts as (select doc_id as video_id, {spiced('text')} as text from documents)"
MARKED = r"""
parts as (
  select doc_id as video_id, unnest(string_split(text, chr(10))) as x,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
scripts as (
  select video_id, string_agg(case
      when i % 7 = 3 then '```' || chr(10) || x
      when i % 5 = 1 then '## ' || x
      when i % 5 = 2 then ' - **' || x || '** -- !'
      when i % 5 = 4 then '> ... [' || x || '](http://x.y) .'
      else x || chr(10) end, chr(10) order by i) as text
  from parts group by 1)"""

TERMINAL = f"""(rtrim(%s, {lit(lex.CLOSERS)}) <> '' and lower(rtrim(%s, {lit(lex.CLOSERS)})) not in {inlist(lex.ABBREVIATIONS)}
  and right(rtrim(%s, {lit(lex.CLOSERS)}), 1) in {inlist(lex.TERMINALS)})"""


def terminal(x: str) -> str:
    return TERMINAL % (x, x, x)


WORDS = rf"""
raw as (
  select video_id, regexp_replace(unnest(string_split_regex(text, '{BREAK}')), {STRIP}, '', 'g') as line,
         generate_subscripts(string_split_regex(text, '{BREAK}'), 1) as line_no from scripts),
coded as (
  select *, starts_with(line, '```') as fence,
         sum(starts_with(line, '```')::int) over (partition by video_id order by line_no) as fences from raw),
kinds as (
  select *, case when fence or fences % 2 = 1 or line = '' then 'quiet'
              when regexp_matches(line, {lit(lex.HEADING)}) or regexp_matches(line, {lit(lex.LIST_ITEM)}) then 'alone'
              else 'text' end as kind from coded),
fresh as (
  select *, case when kind <> 'quiet' and (kind = 'alone'
        or coalesce(lag(kind) over (partition by video_id order by line_no), 'quiet') <> 'text') then 1 else 0 end as f from kinds),
paras as (select *, sum(f) over (partition by video_id order by line_no) as para from fresh),
clean as (
  select video_id, line_no, para,
     regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line,
        {lit(lex.HEADING)}, ''), {lit(lex.LIST_ITEM)}, ''), '^[> ]+', ''), {lit(lex.LINK)}, '\1', 'g'),
        {lit(lex.EMPHASIS)}, '', 'g') as t
  from paras where kind <> 'quiet'),
toks as (
  select video_id, line_no, para, unnest(string_split_regex(t, '{WS}+')) as tok,
         generate_subscripts(string_split_regex(t, '{WS}+'), 1) as pos from clean),
owned as (
  select *, regexp_matches(tok, '[\p{{L}}\p{{N}}]') as real,
         sum(regexp_matches(tok, '[\p{{L}}\p{{N}}]')::int) over (partition by video_id order by line_no, pos) as gid
  from toks where tok <> ''),
glued as (
  select video_id, gid, string_agg(tok, '' order by line_no, pos) as text, min(para) filter (where real) as para
  from owned where gid > 0 group by 1, 2),
breaks as (
  select video_id, (gid - 1)::int as word_idx, text,
         coalesce(lead(para) over (partition by video_id order by gid) <> para, true) as paragraph_break,
         dense_rank() over (partition by video_id order by para) - 1 as para_idx from glued),
paced as (
  select *, coalesce(sum((not paragraph_break and {terminal('text')})::int) over (
      partition by video_id order by word_idx rows between unbounded preceding and 1 preceding), 0) as soft from breaks),
words as (
  select video_id, word_idx, text, para_idx, paragraph_break,
         round(word_idx * 0.4::double + soft * 0.35::double + para_idx * 0.8::double, 3) as start,
         round(word_idx * 0.4::double + soft * 0.35::double + para_idx * 0.8::double + 0.4::double, 3) as "end" from paced)"""

MARKS = f""",
hard as (
  select *, case when lead(word_idx) over (partition by video_id order by word_idx) is null then 'end'
            when {terminal('text')} then 'punct' when paragraph_break then 'pause' end as reason from words)"""
SENTS = """,
numbered as (
  select *, coalesce(count(reason) over (partition by video_id order by word_idx
      rows between unbounded preceding and 1 preceding), 0)::int as sent_idx from hard),
sents as (
  select video_id, sent_idx, min(start) as start, arg_max("end", word_idx) as "end", min(word_idx) as word_start,
         max(word_idx) + 1 as word_end, arg_max(reason, word_idx) as end_reason, string_agg(text, ' ' order by word_idx) as text
  from numbered group by 1, 2)"""
# estimated timing is uniform inside a run, so the 15 s limit falls on every 38th word (38 * 0.4 >= 15)
SOFT = """,
runs as (
  select *, coalesce(count(reason) over (partition by video_id order by word_idx
      rows between unbounded preceding and 1 preceding), 0) as run from hard),
placed as (
  select *, row_number() over (partition by video_id, run order by word_idx) as p from runs),
soft as (
  select * replace (coalesce(reason, case when p % 38 = 0 then 'max_length' end) as reason) from placed)"""
SOFT_SENTS = SENTS.replace("from hard", "from soft")

TOKENS = f"list_filter(list_transform(string_split_regex(text, '{WS}+'), lambda x: lower(trim(x, {lit(lex.PUNCT)}))), lambda x: x <> '')"
FILLERS = (
    "list_transform(regexp_extract_all(' ' || array_to_string(tokens, '  ') || ' ', "
    + lit(filler_pattern()) + ", 1), lambda x: replace(trim(x), '  ', ' '))"
)
BARE = f"rtrim(regexp_replace(text, {STRIP}, '', 'g'), {lit(lex.QUESTION_CLOSERS)})"
ADJACENT = "(select count(*) from (select unnest(list_zip(%s, list_slice(%s, 2, len(%s)))) as z) q where z[1] = z[2])"
REPEATS = "len(list_filter(range(1, len(%s)), lambda i: %s[i] = %s[i + 1]))"
BARETOKS = TOKENS.replace("string_split_regex(text,", "string_split_regex(bare,")
QUESTION = f"""case when right(bare, 1) = '?' then true when right(bare, 1) in ('.', '!', '।') then false
  else coalesce(baretoks[1] in {inlist(lex.flat(lex.INTERROGATIVES))} or baretoks[len(baretoks)] in {inlist(lex.flat(lex.QUESTION_TAGS))}, false) end"""
CLAIM = f"len(list_filter(tokens, lambda x: regexp_matches(x, '{DIGIT}') or x in {inlist(lex.flat(lex.NUMBER_WORDS))})) > 0"


def features(table: str, out: str) -> str:
    return f"""
{out}0 as (select *, {TOKENS} as tokens, {BARE} as bare from {table}),
{out}1 as (select *, {BARETOKS} as baretoks from {out}0),
{out} as (select *, {FILLERS} as fillers, {QUESTION} as is_question, {CLAIM} as has_claim from {out}1)"""


TURNS = f"""with t0 as (
  select conv_id as video_id, turn::int as sent_idx, turn, {spiced('text')} as t from conversations),
turns as (
  select video_id, sent_idx, case when turn % 3 = 0 then rtrim(t, '.!?') || '?"' when turn % 2 = 1 then rtrim(t, '.!?') else t end as text
  from t0),""" + features("turns", "feats")

TILES = """,
tw as (select *, floor(start / 12)::int as idx from words),
last as (select video_id, max("end") as last from words group by 1),
tiles as (
  select video_id, idx, 'speech' as kind, idx * 12::double as start, least((idx + 1) * 12::double, round(last + 0.5::double, 3)) as "end",
         min(word_idx) as word_start, max(word_idx) + 1 as word_end
  from tw join last using (video_id) group by video_id, idx, last)"""
SEG_SENTS = """,
ss as (
  select s.*, t.idx from sents s join tiles t on t.video_id = s.video_id
   and s.word_end > t.word_start and s.word_end <= t.word_end)""" + "," + features("ss", "sf")
OCC = f""",
grams as (
  select video_id, sent_idx, idx, start, unnest(range(0, greatest(len(tokens) - 2, 0))) as pos, tokens from sf),
occ as (
  select video_id, sent_idx, idx, start, pos::int as pos, tokens[pos + 1] || ' ' || tokens[pos + 2] || ' ' || tokens[pos + 3] as phrase from grams
  where not exists (select 1 from (values (tokens[pos + 1]), (tokens[pos + 2]), (tokens[pos + 3])) v(w) where w in {inlist(lex.flat(lex.FILLER_WORDS))})
    and (tokens[pos + 1] in {inlist(lex.flat(lex.STOPWORDS))})::int + (tokens[pos + 2] in {inlist(lex.flat(lex.STOPWORDS))})::int
      + (tokens[pos + 3] in {inlist(lex.flat(lex.STOPWORDS))})::int <= 1)""".replace(
    f"""not exists (select 1 from (values (tokens[pos + 1]), (tokens[pos + 2]), (tokens[pos + 3])) v(w) where w in {inlist(lex.flat(lex.FILLER_WORDS))})""",
    " and ".join(f"tokens[pos + {k}] not in {inlist(lex.flat(lex.FILLER_WORDS))}" for k in (1, 2, 3)),
)
RANKED = """,
said0 as (
  select video_id, phrase, count(*) as count, min(struct_pack(a := sent_idx, b := pos)) as first from occ group by 1, 2 having count(*) >= 3),
said as (
  select *, row_number() over (partition by video_id order by count desc, first, phrase) as rank from said0),
rocc as (select o.*, s.count, s.rank, s.first from occ o join said s using (video_id, phrase)),
near as (
  select a.video_id, a.phrase, a.count, a.rank, a.first, a.sent_idx, a.pos, a.idx, a.start,
         exists (select 1 from rocc b where b.video_id = a.video_id and b.sent_idx = a.sent_idx
                 and b.pos in (a.pos - 1, a.pos + 1) and b.rank < a.rank) as near,
         row_number() over (partition by a.video_id, a.phrase order by a.sent_idx, a.pos) - 1 as k from rocc a),
listed as (select video_id, phrase, any_value(count) as count, any_value(rank) as rank, any_value(first) as first from near group by 1, 2 having not bool_and(near))"""

PLAIN = "with " + DOCS + "," + WORDS
TILED = PLAIN + MARKS + SOFT + SOFT_SENTS + TILES + SEG_SENTS
PACE = """,
wps as (select *, (word_end - word_start) / greatest("end" - start, 1e-6::double) as w from tiles),
paced2 as (select *, quantile_cont(w, 0.5) over (partition by video_id) as med from wps)"""
RND = "round_even(%s, 4)"

SQL = {
    "src_scripts": "with " + MARKED + "," + WORDS + """
select video_id, para_idx, count(*) as n_words, string_agg(text, ' ' order by word_idx) as text from words group by 1, 2""",
    "script_timing": PLAIN + """ select video_id, word_idx, text, start, "end", paragraph_break from words""",
    "is_terminal": f"""with t as (select doc_id, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') as w from documents)
select doc_id, len(w)::int as n_tokens, len(list_filter(w, lambda x: {terminal("(x || '"+'")'+"')")}))::int as n_terminal from t""",
    "join_tokens": f"""with t as (select doc_id, list_filter(string_split_regex(translate(text, 'etn', '。中文'), '{WS}+'), lambda x: x <> '') as w from documents)
select doc_id, list_reduce(w, lambda a, b: a || case when regexp_matches(right(a, 1), '[。中文]') and regexp_matches(left(b, 1), '[。中文]') then '' else ' ' end || b) as text from t""",
    "build_sentences_context_free": PLAIN + MARKS + SENTS + " select * from sents",
    "build_sentences": PLAIN + MARKS + SOFT + SOFT_SENTS + " select * from sents",
    "tokens": TURNS + " select video_id, sent_idx, tokens from feats",
    "fillers": TURNS + " select video_id, sent_idx, fillers from feats",
    "repeated_words": TURNS + f" select video_id, sent_idx, {REPEATS % (('tokens',) * 3)}::int as repeated_words from feats",
    "questions": TURNS + " select video_id, sent_idx, is_question from feats",
    "number_claims": TURNS + " select video_id, sent_idx, has_claim from feats",
    "sentence_to_segment": TILED + " select video_id, sent_idx, idx, word_start, word_end from sf",
    "pace": PLAIN + TILES + PACE + f" select video_id, idx, {RND % 'w'} as words_per_second, {RND % '(w / med)'} as pace_ratio from paced2",
    "pauses": PLAIN + TILES + """,
gaps as (select *, lead(start) over (partition by video_id, idx order by word_idx) - "end" as gap from tw)
select video_id, idx, coalesce(round_even(max(gap) filter (where gap > 0), 3), case when count(*) > 1 then 0 end) as longest_pause_s,
       round_even(arg_max("end", struct_pack(a := gap, b := -"end")) filter (where gap > 0), 3) as longest_pause_at,
       count(*) filter (where gap >= 0.8::double) as long_pause_count from gaps group by 1, 2""",
    "phrase_occurrences": TILED + OCC + " select video_id, sent_idx, pos, phrase from occ",
    "repeated_phrases": TILED + OCC + RANKED + " select video_id, phrase, count, rank, first.a as first_sent, first.b as first_pos from listed",
    "phrase_stats": TILED + OCC + RANKED + """,
top as (select *, row_number() over (partition by video_id order by rank) as place from listed)
select t.video_id, t.phrase, t.count, t.place, list(n.start order by n.k) as times from top t join near n using (video_id, phrase)
where place <= 10 and n.k < 10 group by all""",
    "phrase_repeats": TILED + OCC + RANKED + """,
f as (select video_id, phrase, min(start) as first_at from near group by 1, 2),
again as (
  select n.video_id, n.idx, n.phrase, l.count, f.first_at, min(n.start) as "at" from near n join listed l using (video_id, phrase)
  join f using (video_id, phrase) where n.k >= 1 group by all)
select * from (select *, row_number() over (partition by video_id, idx order by count desc, "at", phrase) as place from again) where place <= 3""",
    "segment_text_agg": TILED + PACE + f""",
per as (
  select video_id, idx, count(*) as n, flatten(list(tokens order by sent_idx)) as toks, flatten(list(fillers order by sent_idx)) as fillers,
         count(*) filter (where is_question) as qc, count(*) filter (where has_claim) as cc from sf group by 1, 2)
select p.video_id, p.idx, p.start, p."end", p.kind, word_end - word_start as word_count, {RND % 'w'} as words_per_second,
       {RND % '(w / med)'} as pace_ratio, coalesce(len(fillers), 0)::int as filler_count,
       {RND % '(coalesce(len(fillers), 0) / nullif(word_end - word_start, 0)::double)'} as filler_ratio,
       coalesce(fillers, []) as fillers, coalesce({REPEATS % (('toks',) * 3)}, 0)::int as repeated_word_count,
       coalesce(qc, 0) as question_count, {RND % '(qc / n::double)'} as question_density,
       coalesce(cc, 0) as claim_count, {RND % '(cc / n::double)'} as claim_density
from paced2 p left join per using (video_id, idx)""",
}
