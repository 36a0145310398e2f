"""DuckDB SQL that states each registered query independently of the Spark plans."""

from __future__ import annotations

from charlascope.plans import fixtures
from charlascope.plans.queries import MIN_SIM
from charlascope.settings import (
    DECISIONS,
    EVIDENCE_PER_INTENT,
    MAX_CONTEXT_MESSAGES,
    MAX_FEATURES,
    NEUTRAL_FLOWS,
    OFF_DOMAIN_WORDS,
    REPORT_COLUMNS,
    SLOT_PATTERNS,
    TOP_INTENTS,
)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _derived(expressions: dict[str, str], source: str, *keep: str) -> str:
    columns = ", ".join([*keep, *[f"{sql} as {name}" for name, sql in expressions.items()]])
    return f"select {columns} from {source}"


def _norm(x: str) -> str:
    ascii_only = rf"lower(regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g'))"
    return rf"regexp_replace({ascii_only}, '^\s+|\s+$', '', 'g')"


def _flow(x: str) -> str:
    return (
        f"case when starts_with(upper(trim({x})), 'NO_MATCH') then 'NO_MATCH'"
        f" when starts_with(upper(trim({x})), 'CHIT_') then 'CHIT' else split_part(trim({x}), '_', 1) end"
    )


def _slots(norm: str) -> str:
    cases = [
        f"case when {' or '.join(f'''regexp_matches({norm}, '{p}')''' for p in patterns)} then '{slot}' end"
        for slot, patterns in SLOT_PATTERNS.items()
    ]
    return f"concat_ws(',', {', '.join(cases)})"


def _short(text: str) -> str:
    return rf"len(regexp_split_to_array(trim({text}), '\s+')) <= 4"


def _off_domain(text: str) -> str:
    return "(" + " or ".join(f"contains(lower({text}), '{w}')" for w in OFF_DOMAIN_WORDS) + ")"


def _terms(key: str, norm: str, source: str) -> str:
    """Term counts of the texts of a CTE: single words and neighbouring pairs."""
    words = rf"regexp_extract_all({norm}, '\w\w+')"
    return f"""
  select {key}, term, count(*) as n from (
    select {key}, word as term from (select {key}, unnest({words}) as word from {source}) a
    union all
    select {key}, word || ' ' || next_word from (
      select {key}, word, lead(word) over (partition by {key} order by place) as next_word from (
        select {key}, unnest({words}) as word, generate_subscripts({words}, 1) as place from {source}) b) c
    where next_word is not null) d
  group by {key}, term"""


CHATS = _derived(fixtures.CHATS, "conversations")
LONG_CHATS = (
    "select session_id, cast(row_number() over (partition by session_id order by ts, event_id) - 1 as int) as turn_index,"
    f" event_id as ord, tipo, texto, intent_detectado from ({_derived(fixtures.LONG_CHATS, 'events', 'ts', 'event_id')}) e"
)
ALL_CHATS = (
    "select session_id, turn_index, ord, tipo, texto, intent_detectado from"
    f" ({CHATS}) s union all select * from ({LONG_CHATS}) l"
)


def _cases(chats: str) -> str:
    """CTEs ``turns`` and ``cases`` over a chat query."""
    return f"""
flagged as (
  select *, tipo = 'usuario' as usr, tipo = 'bot' and starts_with(upper(intent_detectado), 'NO_MATCH') as missed,
    trim(intent_detectado) <> '' and upper(flow) <> 'NO_MATCH' as valid,
    trim(intent_detectado) <> '' and upper(flow) <> 'NO_MATCH' and flow <> ''
      and flow not in {_in(NEUTRAL_FLOWS)} as topical
  from (select *, {_flow('intent_detectado')} as flow from ({chats}) c) f),
turns as (
  select *,
    last_value(case when topical then flow end ignore nulls) over b as topic_flow,
    last_value(case when topical then trim(intent_detectado) end ignore nulls) over b as topic_intent,
    last_value(case when valid and flow <> '' then flow end ignore nulls) over b as any_flow,
    first_value(case when valid then trim(intent_detectado) end ignore nulls) over b as first_intent,
    last_value(case when usr then turn_index end ignore nulls) over b as trigger_at
  from flagged
  window b as (partition by session_id order by turn_index rows between unbounded preceding and 1 preceding)),
cases as (
  select c.session_id || ':' || c.turn_index as case_id, c.session_id, c.ord, c.turn_index, c.texto as bot_text,
    c.trigger_at, coalesce(u.texto, '') as trigger_text, {_norm("coalesce(u.texto, '')")} as norm,
    coalesce(u.topic_flow, u.any_flow, 'UNKNOWN') as flow_ref,
    coalesce(u.topic_intent, u.first_intent, '') as last_valid_intent
  from turns c left join turns u on u.session_id = c.session_id and u.turn_index = c.trigger_at
  where c.missed)"""


def _context(ignore_empty: bool) -> str:
    given = " and flow <> ''" if ignore_empty else ""
    return f"""
messages as (
  select c.case_id, t.turn_index, t.tipo, t.texto, trim(t.intent_detectado) as intent,
    sum(case when t.flow not in {_in(NEUTRAL_FLOWS)} and t.flow <> c.flow_ref{given.replace('flow', 't.flow')}
      then 1 else 0 end) over (partition by c.case_id order by t.turn_index desc) as strays
  from cases c join turns t on t.session_id = c.session_id
    and t.turn_index between c.trigger_at - {MAX_CONTEXT_MESSAGES - 1} and c.trigger_at
  where upper(t.flow) <> 'NO_MATCH'),
context as (
  select case_id, cast(row_number() over (partition by case_id order by turn_index) - 1 as int) as pos, turn_index,
    tipo, texto, intent
  from messages where strays < 2)"""


_USER_LINES = (
    "select conv_id, turn, text, unnest(string_split(text, chr(10))) as line,"
    " generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from conversations where role = 'user'"
)
TRAINING = f"""
phrases as (
  select *, split_part(intent, '_', 1) as flow, {_norm('phrase')} as phrase_norm from (
    {_derived(fixtures.DOCUMENT_PHRASES, 'documents')}
    union all
    {_derived(fixtures.USER_PHRASES, f"({_USER_LINES}) l")} where trim(line) <> '') p),
phrase_terms as ({_terms('row_id', 'phrase_norm', 'phrases')}),
vocab as (
  select term, cast(sum(n) as bigint) as total, count(*) as df,
    ln((1.0 + (select count(*) from phrases)) / (1.0 + count(*))) + 1.0 as idf
  from phrase_terms group by term order by total desc, term limit {MAX_FEATURES})"""
SIMILARITY = f"""
postings as (
  select row_id, term, n * idf / sqrt(sum(n * idf * n * idf) over (partition by row_id)) as w
  from phrase_terms join vocab using (term)),
texts as (select distinct norm from cases where norm <> ''),
text_terms as ({_terms('norm', 'norm', 'texts')}),
queries as (
  select norm, term, n * idf / sqrt(sum(n * idf * n * idf) over (partition by norm)) as w
  from text_terms join vocab using (term)),
sims as (
  select q.norm, p.row_id, round(sum(q.w * p.w), 10) as sim from queries q join postings p using (term)
  group by q.norm, p.row_id)"""
CANDIDATES = f"""
scan as (
  select t.norm, p.intent, p.flow, p.row_id, coalesce(s.sim, 0.0) as sim,
    row_number() over (partition by t.norm, p.intent order by coalesce(s.sim, 0.0) desc, p.row_id) as place
  from texts t cross join phrases p left join sims s on s.norm = t.norm and s.row_id = p.row_id),
intents as (
  select norm, intent, any_value(flow) as flow, max(sim) as best, min(row_id) as first_row_id, count(*) as hits,
    sum(case when place <= 5 then sim else 0.0 end) / least(5, count(*)) as mean5
  from scan group by norm, intent),
scored as (
  select c.case_id, i.norm, i.intent, i.flow, i.first_row_id,
    round((0.65 * best + 0.25 * mean5 + 0.10 * ln(1 + hits))
      * case when i.flow = c.flow_ref and c.flow_ref not in ('UNKNOWN', 'CHIT') then 1.1 else 1.0 end, 4) as score
  from cases c join intents i using (norm)),
ranked as (
  select *, cast(row_number() over (partition by case_id order by score desc, first_row_id) as int) as rank
  from scored qualify rank <= {TOP_INTENTS}),
evidence as (
  select r.case_id, r.intent, r.rank as intent_rank, s.row_id, s.sim, s.place
  from ranked r join scan s on s.norm = r.norm and s.intent = r.intent and s.place <= {EVIDENCE_PER_INTENT})"""
RETRIEVAL = f"{_cases(CHATS)},{TRAINING},{SIMILARITY},{CANDIDATES}"

BLOCKS = """
blocks as (
  select ord, doc_id, text, case when lag(intent) over w = intent then null else intent end as intent_raw,
    case when lag(intent) over w = intent then null else lang end as language_raw
  from (select row_number() over (order by lang, source, doc_id) as ord, doc_id, lang, text,
      concat(lang, '_', source) as intent from documents) z
  window w as (order by ord)),
filled as (
  select *, last_value(intent_raw ignore nulls) over (order by ord) as intent,
    last_value(language_raw ignore nulls) over (order by ord) as language
  from blocks)"""

TRIGGERS = f"""
triggers as (
  select *, {_slots('norm')} as slots, flow_ref not in ('UNKNOWN', 'CHIT') as known,
    flow_ref not in ('UNKNOWN', 'CHIT') and best_flow = flow_ref and best_sim >= 0.72 as strong_here
  from (select *, {_norm('texto')} as norm from
    ({_derived(fixtures.TRIGGERS, 'events')} where {fixtures.ERRORS}) e) n)"""
_MISSING = f"(known and slots <> '' and ({_short('texto')} or contains(slots, 'AMOUNT_QUERY')))"
RESPONSES = f"""
responses as (
  select * from (
    {_derived(fixtures.RESPONSES, 'events')} where {fixtures.ERRORS}
    union all
    {_derived(fixtures.SECOND_RESPONSES, 'events')} where {fixtures.ERRORS}) r
  where response is not null),
objects as (
  select case_id, attempt, regexp_extract(response, '(?s)\\{{.*\\}}') as object from responses),
chosen as (
  select case_id, arg_min(object, attempt) filter (object <> '' and json_valid(object)) as object
  from objects group by case_id),
parsed as (
  select case_id,
    coalesce(json_extract_string(object, '$.decision'), '') as decision,
    coalesce(json_extract_string(object, '$.flow_recommended'), '') as flow_recommended,
    coalesce(json_extract_string(object, '$.intent_recommended[0]'), '') as intent_top,
    coalesce(cast(json_extract(object, '$.improvements') as varchar), '[]') as improvements,
    coalesce(cast(json_extract(object, '$.new_training_phrases') as varchar), '{{}}') as new_training_phrases,
    case when json_type(object, '$.confidence') is null then 0.5
      else try_cast(json_extract_string(object, '$.confidence') as double) end as confidence,
    object is not null as found
  from chosen)"""
JUDGED = f"""
judged as (
  select t.case_id, t.ord, t.texto, t.slots, t.flow_ref, t.best_sim, t.strong_here,
    case when p.case_id is null then 'no' when p.found and p.confidence is not null then 'yes' else 'error' end as judged,
    p.decision as d, p.flow_recommended as f, p.intent_top as i, p.confidence as c,
    coalesce(p.improvements, '[]') as imp, coalesce(p.new_training_phrases, '{{}}') as ntp, t.best_flow
  from triggers t left join parsed p using (case_id)),
decided as (
  select case_id, ord, texto, slots, flow_ref, best_sim, strong_here, judged,
    case when judged = 'yes' then d else 'AMBIGUOUS' end as decision,
    case when judged = 'yes' then f else flow_ref end as flow_recommended,
    case when judged = 'yes' then i when judged = 'no' then best_flow || '_k1' else '' end as intent_top,
    case when judged = 'yes' then imp else '[]' end as improvements,
    case when judged = 'yes' then ntp else '{{}}' end as new_training_phrases,
    case when judged = 'yes' then c when judged = 'no' then 0.5 else 0.0 end as confidence,
    judged <> 'yes' as review_flag
  from judged)"""


def _validated(source: str, best: str, strong_here: str, open_rows: str) -> str:
    overlooked = f"({strong_here} and contains(decision, 'NEW_INTENT'))"
    slot_ignored = f"(slots <> '' and {_short('texto')} and not contains(decision, 'MISSING_PARAMETER_HANDLER'))"
    off = f"({best} < 0.55 and decision <> 'OUT_OF_SCOPE' and {_off_domain('texto')})"
    return f"""
checked as (
  select * replace (
    case when {open_rows} and {off} then 'OUT_OF_SCOPE' else decision end as decision,
    case when {open_rows} then cast(printf('%.2f', least(confidence, case when {overlooked} then 0.6 else confidence end,
      case when {slot_ignored} then 0.65 else confidence end)) as double) else confidence end as confidence,
    case when {open_rows} then ({overlooked} or {slot_ignored}) and not {off} else review_flag end as review_flag)
  from {source})"""


REPORT = (
    TRIGGERS
    + ","
    + RESPONSES
    + ","
    + JUDGED
    + ","
    + _validated("decided", "best_sim", "strong_here", "judged = 'yes'")
    + """,
report as (
  select *, coalesce(nullif(trim(flow_ref), ''), 'UNKNOWN') as flow,
    coalesce(nullif(trim(intent_top), ''), 'SIN_INTENT') as intent
  from checked),
improved as (
  select flow, intent, ord, nth, item ->> '$' as improvement from (
    select flow, intent, ord, unnest(cast(improvements as json[])) as item,
      generate_subscripts(cast(improvements as json[]), 1) as nth from report) i
  where json_type(item) = 'VARCHAR'),
proposed as (
  select flow, ord, key_at, intent_key, nth, item ->> '$' as phrase from (
    select flow, ord, key_at, intent_key, unnest(list) as item, generate_subscripts(list, 1) as nth from (
      select flow, ord, key_at, intent_key,
        case when json_type(value) = 'ARRAY' then cast(value as json[]) else [value] end as list from (
        select flow, ord, key_at, intent_key, json_extract(new_training_phrases, '$."' || intent_key || '"') as value from (
          select flow, ord, new_training_phrases, unnest(json_keys(new_training_phrases)) as intent_key,
            generate_subscripts(json_keys(new_training_phrases), 1) as key_at from report) k) v) l) p),
phrase_places as (
  select flow, intent_key, phrase, min((ord, key_at, nth)) as place from proposed group by flow, intent_key, phrase)"""
)


def _with(ctes: str, select: str) -> str:
    return f"with {ctes.strip()}\n{select}"


def _first_seen(keys: str, value: str, source: str, place: str, name: str) -> str:
    return (
        f"select {keys}, row_number() over (partition by {keys} order by p) as pos, {name}"
        f" from (select {keys}, {value} as {name}, min({place}) as p from {source} group by {keys}, {value}) s"
    )


def _messages(keys: str, limit: int) -> str:
    first = _first_seen(keys, "trim(texto)", "(select * from report where trim(texto) <> '') r", "ord", "message")
    return f"select * replace (cast(pos as int) as pos) from ({first}) m where pos <= {limit}"


def _flat(source: str, n_intents: str, best_sim: str) -> str:
    slots = "case when slots = '' then '[]' else '[\"' || replace(slots, ',', '\",\"') || '\"]' end"
    return (
        f"select case_id, session_id, texto as mensaje_no_match, bot_text as bot_no_match_text, flow_ref,"
        f" last_valid_intent, decision, flow_recommended, intent_top, {n_intents} as n_intents, {best_sim} as best_sim,"
        f" {slots} as slot_signals, improvements, new_training_phrases, confidence, review_flag from {source}"
    )


_CHAT_ROWS = f""",
chat_rows as (
  select c.case_id, c.session_id, c.bot_text, c.trigger_text as texto, c.flow_ref, c.last_valid_intent, {_slots('c.norm')} as slots,
    c.flow_ref not in ('UNKNOWN', 'CHIT') as known, coalesce(e.best, 0.0) as best_sim, coalesce(e.n, 0) as n_intents,
    coalesce(e.top_intent, '') as intent_top, coalesce(e.first_sim, -1.0) as first_sim,
    c.flow_ref not in ('UNKNOWN', 'CHIT') and coalesce(e.best_here, 0.0) >= 0.72 as strong_here,
    c.flow_ref as flow_recommended, '[]' as improvements, '{{}}' as new_training_phrases
  from cases c left join (
    select v.case_id, max(v.sim) as best, count(distinct v.intent) as n, max(case when r.flow = k.flow_ref then v.sim end) as best_here,
      any_value(case when v.intent_rank = 1 then v.intent end) as top_intent,
      max(case when v.intent_rank = 1 then v.sim end) as first_sim
    from evidence v join ranked r on r.case_id = v.case_id and r.intent = v.intent join cases k on k.case_id = v.case_id
    group by v.case_id) e on e.case_id = c.case_id)"""
_RULES = (
    f"case when {_MISSING} then 'MISSING_PARAMETER_HANDLER' when strong_here then 'MISSED_EXISTING_INTENT_IN_FLOW'"
    f" when best_sim >= 0.72 then 'FLOW_SWITCH' when best_sim < 0.55 and {_off_domain('texto')} then 'OUT_OF_SCOPE'"
    " when known then 'NEW_INTENT_IN_FLOW' else 'AMBIGUOUS' end"
)


def _summary() -> str:
    decisions = lambda keys, order: (
        f"select {keys}, string_agg(decision || '(' || n || ')', ', ' order by {order}) as d from"
        f" (select {keys}, decision, count(*) as n, min(ord) as f from report where decision <> '' group by {keys}, decision) c"
        f" group by {keys}"
    )
    counts = lambda keys: f"select {keys}, count(*) as n from report group by {keys}"
    return _with(
        REPORT,
        f"""
, lines as (
  select flow, 0 as part, 0 as item, 'cases: ' || n as line from ({counts('flow')}) a
  union all select flow, 1, 0, 'decisions: ' || d from ({decisions('flow', 'n desc, f')}) b
  union all select flow, 2, pos, 'improvement: ' || improvement
    from ({_first_seen('flow', 'improvement', 'improved', '(ord, nth)', 'improvement')}) c where pos <= 15
  union all select flow, 3, item, 'phrases: ' || intent_key || ': ' || shown || case when n > 5 then '...' else '' end from (
    select flow, intent_key, count(*) as n, row_number() over (partition by flow order by min(place)) as item,
      string_agg(phrase, ' / ' order by pos) filter (pos <= 5) as shown
    from (select *, row_number() over (partition by flow, intent_key order by place) as pos from phrase_places) q
    group by flow, intent_key) d where item <= 10)
select '' as section, 0 as ord, 'total cases: ' || count(*) as line from report
union all
select flow as section, cast(row_number() over (partition by flow order by part, item) as int) as ord, line from lines
union all
select c.flow || '|' || c.intent, 1, 'cases: ' || c.n || ', decisions: ' || coalesce(d.d, '')
from ({counts('flow, intent')}) c left join ({decisions('flow, intent', 'f')}) d on d.flow = c.flow and d.intent = c.intent""",
    )


def _round_trips(chat_turns: str) -> dict[str, str]:
    sunk = (
        "case_id, split_part(case_id, ':', 1) as session_id, texto as mensaje_no_match, 'no entendi' as bot_no_match_text,"
        " flow_ref, decision, flow_recommended, intent_top, case when slots = '' then '[]' else '[\"' ||"
        " replace(slots, ',', '\",\"') || '\"]' end as slot_signals, improvements, new_training_phrases, confidence, review_flag"
    )
    in_order = _with(REPORT, f"select row_number() over (order by ord) as pos, {sunk} from report")
    body = lambda section, keys, name: (
        f"select '{section}' as section, {name} as key, count(*) as cases,"
        " md5(coalesce(string_agg(decision, ',' order by ord) filter (decision <> ''), '')) as decisions_md5"
        f" from report group by {keys}"
    )
    counts = lambda keys, name: (
        f"select {name} as key, string_agg(decision || ':' || n, ',' order by f) as counts from (select {keys}, decision,"
        f" count(*) as n, min(ord) as f from report where decision <> '' group by {keys}, decision) c group by {keys}"
    )
    improved = lambda keys, name: (
        f"select {name} as key, md5(string_agg(improvement, '|' order by pos)) as improvements_md5"
        f" from ({_first_seen(keys, 'improvement', 'improved', '(ord, nth)', 'improvement')}) i group by {keys}"
    )
    part = lambda section, keys, name: (
        "select b.section, b.key, b.cases, b.decisions_md5, coalesce(c.counts, '') as counts,"
        f" coalesce(i.improvements_md5, md5('')) as improvements_md5 from ({body(section, keys, name)}) b"
        f" left join ({counts(keys, name)}) c using (key) left join ({improved(keys, name)}) i using (key)"
    )
    return {
        "csv_chat_turns": chat_turns,
        "csv_event_turns": "select row_number() over (order by ord) - 1 as ord, session_id, tipo, texto, intent_detectado,"
        f" starts_with(upper(intent_detectado), 'NO_MATCH') as is_no_match from ({LONG_CHATS}) c",
        "csv_chat_preview": "select case when turn_index = 0 then session_id else '' end as session_id, tipo as tipo_mensaje,"
        f" texto as ds_wts_message, intent_detectado as ds_wts_intent from ({CHATS}) c",
        "csv_training": _with(
            BLOCKS,
            "select ord - 1 as row_id, intent, split_part(intent, '_', 1) as flow, coalesce(language_raw, 'es') as language,"
            " length(text) as n_chars from filled",
        ),
        "csv_training_preview": _with(BLOCKS, "select ord - 1 as row_id, intent, language from filled"),
        "cases_round_trip": in_order,
        "audit_round_trip": in_order,
        "debug_round_trip": _with(
            REPORT, "select replace(case_id, ':', '_') as debug_id, case_id, decision, confidence, review_flag from report"
        ),
        "empty_report_files": f"select 'case file' as part, '{','.join(REPORT_COLUMNS)}' as line union all select 'cases', '0'",
        "rollup_documents": _with(
            REPORT,
            "select 'total_casos_no_match' as section, '' as key, count(*) as cases, md5('') as decisions_md5, '' as counts,"
            f" md5('') as improvements_md5 from report union all {part('por_flow', 'flow', 'flow')}"
            " union all " + part("por_intent", "flow, intent", "flow || '|' || intent"),
        ),
    }


def registered() -> dict[str, str]:
    found = _queries()
    return found | _round_trips(found["chat_turns"])


def _queries() -> dict[str, str]:
    retrieval_rows = RETRIEVAL + _CHAT_ROWS
    open_rows = (
        "(select *, 'AMBIGUOUS' as decision, 0.5 as confidence, true as review_flag from chat_rows) o"
    )
    rule_rows = f"{_RULES} as decision, cast(0.5 as double) as confidence, true as review_flag"
    judged_rows = (
        "(select *, split_part(case_id, ':', 1) as session_id, 'no entendi' as bot_text, '' as last_valid_intent,"
        " case when judged = 'yes' then 0 else 1 end as n_intents from checked) o"
    )
    return {
        "chat_turns": f"""
select session_id, cast(row_number() over (partition by session_id order by ord) - 1 as int) as turn_index, tipo,
  intent_detectado, {_norm('intent_detectado')} as intent_norm,
  starts_with(upper(intent_detectado), 'NO_MATCH') as is_no_match, {_flow('intent_detectado')} as flow_from_intent,
  length(texto) as n_chars, length({_norm('texto')}) as n_norm
from ({CHATS}) c""",
        "normalize_text": f"select session_id, turn_index, {_norm('texto')} as texto_norm from ({CHATS}) c",
        "training_ffill": _with(
            BLOCKS,
            "select ord as row_id, intent, split_part(intent, '_', 1) as flow, coalesce(language_raw, 'es') as language,"
            " length(text) as n_chars from filled",
        ),
        "intent_preview_ffill": _with(BLOCKS, "select ord as row_id, intent, language from filled"),
        "row_ids": "select doc_id, row_number() over (order by lang, source, doc_id) - 1 as row_id from documents",
        "no_match_cases": _with(
            _cases(ALL_CHATS),
            "select case_id, session_id, turn_index, coalesce(trigger_at, -1) as trigger_turn_index,"
            " trigger_text as trigger_user_text, norm as trigger_user_text_norm, bot_text as bot_no_match_text from cases",
        ),
        "flow_reference": _with(_cases(ALL_CHATS), "select case_id, flow_ref, last_valid_intent from cases"),
        "context_window": _with(f"{_cases(LONG_CHATS)},{_context(False)}", "select * from context"),
        "context_window_topics": _with(f"{_cases(LONG_CHATS)},{_context(True)}", "select * from context"),
        "slot_signals": _with(TRIGGERS, "select case_id, slots from triggers"),
        "chat_slot_signals": _with(_cases(CHATS), f"select case_id, {_slots('norm')} as slots from cases"),
        "tfidf_vocab": _with(TRAINING, "select term, total, df, round(idf, 6) as idf from vocab"),
        "phrase_similarity": _with(
            f"{_cases(CHATS)},{TRAINING},{SIMILARITY}",
            f"select c.case_id, s.row_id, round(s.sim, 4) as sim from cases c join sims s using (norm) where s.sim >= {MIN_SIM}",
        ),
        "candidate_intents": _with(RETRIEVAL, "select case_id, rank, intent, flow, score from ranked"),
        "candidate_evidence": _with(
            RETRIEVAL, "select case_id, intent, cast(place as int) as rank, row_id, round(sim, 4) as sim from evidence"
        ),
        "intent_phrases": _with(
            TRAINING,
            "select intent, count(*) over (partition by intent) as hits,"
            " row_number() over (partition by intent order by row_id) as pos, row_id, md5(phrase) as phrase_md5 from phrases",
        ),
        "vector_candidates": """
with units as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
nearest as (
  select q.vec_id as query_id, c.vec_id, c.label, round(list_cosine_similarity(q.v, c.v), 10) as sim
  from units q cross join units c
  qualify row_number() over (partition by q.vec_id order by sim desc, c.vec_id) <= 50),
placed as (
  select *, row_number() over (partition by query_id, label order by sim desc, vec_id) as place from nearest)
select query_id, label, count(*) as hits,
  round(0.65 * max(sim) + 0.25 * sum(case when place <= 5 then sim else 0.0 end) / least(5, count(*))
    + 0.10 * ln(1 + count(*)), 4) as score
from placed group by query_id, label""",
        "confidence_rounding": (
            "select event_id, cast(printf('%.2f', value / 8.0::double) as double) as confidence from events"
        ),
        "judge_prompt": _with(
            f"{RETRIEVAL},{_context(False)}",
            "select c.case_id, c.case_id as payload_case_id, c.flow_ref, c.last_valid_intent,"
            " c.trigger_text as trigger_user_text, coalesce(x.n, 0) as n_context, coalesce(r.n, 0) as n_candidates,"
            " coalesce(r.top_intent, '') as top_intent from cases c"
            " left join (select case_id, count(*) as n from context group by case_id) x using (case_id)"
            " left join (select case_id, count(*) as n, any_value(case when rank = 1 then intent end) as top_intent"
            " from ranked group by case_id) r using (case_id)",
        ),
        "judge_response_parse": _with(
            RESPONSES,
            "select case_id, decision, flow_recommended, intent_top, coalesce(confidence, -1.0) as confidence,"
            f" found and confidence is not null as usable, decision in {_in(DECISIONS)} as known_decision from parsed",
        ),
        "judge_join_defaults": _with(
            f"{TRIGGERS},{RESPONSES},{JUDGED}",
            "select case_id, judged, decision, flow_recommended, intent_top, confidence, review_flag from decided",
        ),
        "post_validate": _with(REPORT, "select case_id, decision, confidence, review_flag from checked"),
        "missing_parameter_flag": _with(TRIGGERS, f"select case_id, {_MISSING} as flag from triggers"),
        "rule_decision": _with(
            f"{TRIGGERS}, ruled as (select *, {rule_rows} from triggers),"
            + _validated("ruled", "best_sim", "strong_here", "true"),
            "select case_id, decision, confidence, review_flag from checked",
        ),
        "case_report": _with(retrieval_rows, _flat(open_rows, "n_intents", "round(first_sim, 4)")),
        "case_report_rules": _with(
            f"{retrieval_rows}, ruled as (select *, {rule_rows} from chat_rows),"
            + _validated("ruled", "best_sim", "strong_here", "true"),
            _flat("checked", "n_intents", "round(first_sim, 4)"),
        ),
        "case_report_judged": _with(REPORT, _flat(judged_rows, "n_intents", "round(best_sim, 4)")),
        "rollup_total": _with(REPORT, "select count(*) as cases from report"),
        "rollup_by_flow": _with(REPORT, "select flow, count(*) as cases from report group by flow"),
        "rollup_by_intent": _with(REPORT, "select flow, intent, count(*) as cases from report group by flow, intent"),
        "rollup_decisions": _with(
            REPORT, "select flow, decision, count(*) as n from report where decision <> '' group by flow, decision"
        ),
        "rollup_decisions_by_intent": _with(
            REPORT,
            "select flow, intent, decision, count(*) as n from report where decision <> '' group by flow, intent, decision",
        ),
        "rollup_decision_sequence": _with(
            REPORT,
            "select flow, ord, decision, row_number() over (partition by flow order by ord) as pos from report"
            " where decision <> ''",
        ),
        "rollup_intent_top": _with(
            REPORT, "select flow, intent_top, count(*) as n from report where intent_top <> '' group by flow, intent_top"
        ),
        "rollup_messages": _with(REPORT, _messages("flow", 50)),
        "rollup_messages_by_intent": _with(REPORT, _messages("flow, intent", 30)),
        "rollup_improvements": _with(REPORT, _first_seen("flow", "improvement", "improved", "(ord, nth)", "improvement")),
        "rollup_improvements_by_intent": _with(
            REPORT, _first_seen("flow, intent", "improvement", "improved", "(ord, nth)", "improvement")
        ),
        "rollup_new_phrases": _with(
            REPORT,
            "select flow, intent_key, phrase, row_number() over (partition by flow, intent_key order by place) as pos"
            " from phrase_places",
        ),
        "rollup_summary_lines": _summary(),
        "quality_metrics": _with(
            REPORT,
            "select 'decision_share' as metric, decision as key, round(count(*) / (select count(*) from report), 6) as value"
            " from report group by decision"
            " union all select 'flow_cases', flow, cast(count(*) as double) from report group by flow"
            " union all select 'intent_suggested', intent_top, cast(count(*) as double) from report"
            " where intent_top <> '' group by intent_top"
            " union all select 'review_rate', '', round(avg(cast(review_flag as int)), 6) from report",
        ),
        "review_sample": _with(REPORT, "select case_id from report order by md5(case_id), case_id limit 50"),
        "review_sample_by_decision": _with(
            REPORT,
            "select case_id, decision from (select case_id, decision, row_number() over"
            " (partition by decision order by md5(case_id), case_id) as p from report) s where p <= 50",
        ),
    }
