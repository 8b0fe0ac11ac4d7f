"""Equivalent SQL for the registered queries, to be run by another engine on the same tables.

Written from the definitions, not from the Spark code: plain windows over whole sessions, self-joins
for prompt histories, Gauss-Jordan elimination for regression, Simpson's rule for p-values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from parleystat import schemas as S
from parleystat.plans.proxies import AVATAR_REQUESTS, REQUESTS, SURVEY, TEXT_REQUESTS, TURNS

_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _select(columns: Sequence[str], source: str) -> str:
    return f"select {', '.join(columns)} from {source}"


SURVEY_CTE = f"survey as ({_select(SURVEY, 'customer')})"
UTTERANCE_CTE = (
    "utterance as (select doc_id as person_id, text from documents "
    "union all select conv_id as person_id, text from conversations)"
)
TURN_CTE = f"turn as ({_select(TURNS, 'events')})"
REQUEST_CTE = f"request as ({_select(REQUESTS, 'events')})"
ARTICLE_CTE = "article as (select cast(doc_id as varchar) as article_id, text from documents)"

SCORED_CTE = f"""{SURVEY_CTE}, scored as (
  select *,
    list_avg([EMP_1, EMP_2, EMP_3, EMP_4, EMP_5])::double as EMP_Mean,
    list_avg([G_ANTHRO_1, G_ANTHRO_2, G_ANTHRO_3, G_ANTHRO_4, G_ANTHRO_5])::double as anthropomorphism_score,
    (P3_do_not_mind_centre_of_attention + P10_make_friends_easily - P14_keep_in_the_background
      - P18_avoid_contact_with_others)::double / 4 as extraversion_score,
    (P6_believe_others_have_good_intentions - P2_hold_a_grudge - P9_cut_others_to_pieces
      + P13_am_easy_to_satisfy)::double / 4 as agreeableness_score,
    case when condition = 'text' then 0 else 1 end::bigint as condition_avatar
  from survey where condition in ('text', 'male_avatar', 'female_avatar'))"""
TOKENS_CTE = f"""{UTTERANCE_CTE}, tokens as (
  select person_id, sum(coalesce(len(regexp_extract_all(text, '[^{_SPACES}]+')), 0))::bigint as total_tokens
  from utterance where person_id is not null group by person_id)"""
FRAME_CTE = f"{SCORED_CTE}, {TOKENS_CTE}, frame as (select s.*, t.total_tokens from scored s left join tokens t using (person_id))"

_DEMO = "Sex is not null and ethnicity_simplified is not null"
_PERS = "extraversion_score is not null and agreeableness_score is not null"
_EMP = "EMP_Mean is not null and EMP_1 is not null"
_TOK = "total_tokens is not null"
_ANTH = "anthropomorphism_score is not null"
SAMPLES = {
    "spec1": _EMP,
    "spec2": f"{_EMP} and {_DEMO}",
    "spec3": f"{_EMP} and {_DEMO} and {_PERS}",
    "spec4": f"{_EMP} and {_DEMO} and {_PERS} and {_TOK}",
    "total_effect": f"{_EMP} and {_DEMO} and {_PERS} and {_TOK}",
    "path_a": f"{_ANTH} and {_DEMO} and {_PERS} and {_TOK}",
    "full_outcome": f"{_EMP} and {_ANTH} and {_DEMO} and {_PERS} and {_TOK}",
}
#: Model 4 over the avatar chats alone: a sample of its own, beside the study's.
AVATAR_SAMPLES = {"spec4_avatars": f"{SAMPLES['spec4']} and condition <> 'text'"}
_PERS_TERMS = ["extraversion_score", "agreeableness_score"]
NUMERIC = {
    "spec1": ["condition_avatar"],
    "spec2": ["condition_avatar"],
    "spec3": ["condition_avatar", *_PERS_TERMS],
    "spec4": ["condition_avatar", *_PERS_TERMS, "total_tokens"],
    "total_effect": ["condition_avatar", *_PERS_TERMS, "total_tokens"],
    "path_a": ["condition_avatar", *_PERS_TERMS, "total_tokens"],
    "full_outcome": ["condition_avatar", "anthropomorphism_score", *_PERS_TERMS, "total_tokens"],
    # Every row is an avatar's here, so the indicator equals the intercept and is left out of this design.
    "spec4_avatars": [*_PERS_TERMS, "total_tokens"],
}


def _outcomes(model: str) -> list[tuple[str, str]]:
    if model == "path_a":
        return [("anthropomorphism_score", "anthropomorphism")]
    return [("EMP_Mean", "EMP_Mean"), ("EMP_1", "EMP_1")]


def _design_ctes(model: str) -> str:
    long = ["select i, 'Intercept' as term, 0 as blk, 1.0::double as v from samp"]
    if model != "spec1":
        long.append(
            "select i, 'C(Sex)[T.' || Sex || ']', 1, 1.0::double from samp where Sex > (select min(Sex) from samp)"
        )
        long.append(
            "select i, 'C(Q(''Ethnicity simplified''))[T.' || ethnicity_simplified || ']', 2, 1.0::double from samp "
            "where ethnicity_simplified > (select min(ethnicity_simplified) from samp)"
        )
    for place, name in enumerate(NUMERIC[model], start=3):
        long.append(f"select i, '{name}', {place}, {name}::double from samp")
    y = [f"select i, {o} as o, {column}::double as v from samp" for o, (column, _) in enumerate(_outcomes(model))]
    return f"""{FRAME_CTE},
samp as materialized (select row_number() over (order by person_id) as i, * from frame where {(SAMPLES | AVATAR_SAMPLES)[model]}),
long as ({' union all '.join(long)}),
terms as materialized (select term, row_number() over (order by blk, term) - 1 as k from (select distinct term, blk from long)),
x as materialized (select i, k, v from long join terms using (term)),
y as materialized ({' union all '.join(y)}),
gram as (select a.k as i, b.k as j, sum(a.v * b.v) as v from x a join x b on a.i = b.i group by a.k, b.k)"""


def _solve_ctes(model: str) -> str:
    count = len(_outcomes(model))
    labels = " ".join(f"when {o} then '{label}'" for o, (_, label) in enumerate(_outcomes(model)))
    return f"""{_design_ctes(model)},
size as (select count(*) as p from terms),
wide as (
  select i, j, v from gram
  union all select x.k, p + y.o, sum(x.v * y.v) from x join y on x.i = y.i, size group by x.k, p + y.o
  union all select k, p + {count} + k, 1.0 from terms, size),
base as (select r.k as i, c.j, coalesce(w.v, 0.0) as v
  from terms r cross join (select unnest(range((select 2 * p + {count} from size))) as j) c
  left join wide w on w.i = r.k and w.j = c.j),
gj(k, i, j, v) as (
  select 0::bigint, i::bigint, j::bigint, v from base
  union all
  select g.k + 1, g.i, g.j, case when g.i = g.k then g.v / piv.v else g.v - col.v * rw.v / piv.v end
  from gj g join gj piv on piv.k = g.k and piv.i = g.k and piv.j = g.k
    join gj rw on rw.k = g.k and rw.i = g.k and rw.j = g.j
    join gj col on col.k = g.k and col.i = g.i and col.j = g.k
  where g.k < (select p from size)),
sol as materialized (select i, j, v from gj where k = (select p from size)),
beta as (select j - p as o, i as k, v as b from sol, size where j >= p and j < p + {count}),
diag as (select i as k, v as d from sol, size where j = p + {count} + i),
pred as (select x.i, beta.o, sum(x.v * beta.b) as yhat from x join beta on x.k = beta.k group by x.i, beta.o),
stats as (
  select y.o, count(*) as n, sum((y.v - yhat) * (y.v - yhat)) as ssr, var_pop(y.v) * count(*) as sst
  from y join pred on y.i = pred.i and y.o = pred.o group by y.o),
tests as (
  select beta.o, beta.k, b, sqrt(ssr / (n - p) * d) as se, b / sqrt(ssr / (n - p) * d) as t, n - p as df,
    atan(abs(b / sqrt(ssr / (n - p) * d)) / sqrt(n - p)) as theta
  from beta join diag on beta.k = diag.k join stats on stats.o = beta.o, size),
simpson as (
  select o, k, sum(w * pow(cos(theta + (pi() / 2 - theta) * s / 4000), df - 1)) * (pi() / 2 - theta) as upper,
    sum(w * pow(cos(pi() / 2 * s / 4000), df - 1)) * pi() / 2 as whole
  from tests cross join (
    select s, case when s = 0 or s = 4000 then 1 when s % 2 = 1 then 4 else 2 end as w
    from (select unnest(range(4001)) as s))
  group by o, k, theta),
coef as (
  select '{model}' as model, case tests.o {labels} end as outcome, term, b as coefficients, se as std, t, upper / whole as p
  from tests join simpson on tests.o = simpson.o and tests.k = simpson.k join terms on terms.k = tests.k),
fits as (
  select '{model}' as model, case o {labels} end as outcome, n::bigint as n, 1 - ssr / sst as r_squared,
    1 - (n - 1)::double / (n - p) * (ssr / sst) as adj_r_squared,
    n * (ln(2 * pi() * ssr / n) + 1) + 2 * p as aic, n * (ln(2 * pi() * ssr / n) + 1) + p * ln(n) as bic
  from stats, size)"""


def rounded(name: str, alias: str | None = None) -> str:
    return f'round({name}, 6) + 0.0 as "{alias or name}"'


def coefficients(models: Sequence[str]) -> str:
    parts = [
        f"""(with recursive {_solve_ctes(model)}
select model, outcome, term, {rounded('coefficients')}, {rounded('std')}, {rounded('t')}, {rounded('p', 'p-value')},
  case when p < 0.05 then '*' when p < 0.1 then '**' else 'ns' end as "Significance" from coef)"""
        for model in models
    ]
    return " union all ".join(parts)


def coefficients_avatars() -> str:
    """Intercept and indicator are one column twice, so the shortest solution halves what the intercept has alone."""
    share = "case when term in ('Intercept', 'condition_avatar') then 0.5 else 1 end"
    return f"""with recursive {_solve_ctes('spec4_avatars')},
doubled as (select coef.* from coef union all select coef.model, coef.outcome, 'condition_avatar', coef.coefficients, coef.std, coef.t, coef.p
  from coef where coef.term = 'Intercept')
select 'spec4' as model, outcome, term, {rounded(f'coefficients * {share}', 'coefficients')}, {rounded(f'std * {share}', 'std')},
  {rounded('t')}, {rounded('p', 'p-value')}, case when p < 0.05 then '*' when p < 0.1 then '**' else 'ns' end as "Significance" from doubled"""


def fit_statistics_avatars() -> str:
    names = ", ".join(rounded(c) for c in ("r_squared", "adj_r_squared", "aic", "bic"))
    return f"with recursive {_solve_ctes('spec4_avatars')} select 'spec4' as model, outcome, n, {names} from fits"


def mediation_effects() -> str:
    def effects(name: str, model: str) -> str:
        return f"{name} as (select * from (with recursive {_solve_ctes(model)} select outcome, term, coefficients, std from coef))"

    parts = ", ".join(effects(n, m) for n, m in (("t", "total_effect"), ("a", "path_a"), ("f", "full_outcome")))
    named = ("t.coefficients", "total"), ("a.coefficients", "path_a"), ("b.coefficients", "path_b"), ("d.coefficients", "direct")
    ab = "a.coefficients * b.coefficients"
    z = f"{ab} / sqrt(power(b.coefficients * a.std, 2) + power(a.coefficients * b.std, 2))"
    shown = ", ".join(f"round({e}, 6) + 0.0 as {n}" for e, n in (*named, (ab, "indirect"), (z, "sobel_z")))
    return f"""with {parts} select t.outcome, {shown} from t, a, f b, f d
where t.term = 'condition_avatar' and a.term = 'condition_avatar' and b.term = 'anthropomorphism_score'
  and d.term = 'condition_avatar' and b.outcome = t.outcome and d.outcome = t.outcome"""


def published_coefficients(model: str) -> str:
    even = ", ".join(
        f'round_even({name} * 10000, 0) / 10000 + 0.0 as "{alias}"'
        for name, alias in (("coefficients", "coefficients"), ("std", "std"), ("t", "t"), ("p", "p-value"))
    )
    return f"""with recursive {_solve_ctes(model)}
select model, outcome, term, {even}, case when p < 0.05 then '*' when p < 0.1 then '**' else 'ns' end as "Significance"
from coef"""


def fit_statistics(models: Sequence[str]) -> str:
    names = ("r_squared", "adj_r_squared", "aic", "bic")
    parts = [
        f"(with recursive {_solve_ctes(model)} select model, outcome, n, {', '.join(rounded(c) for c in names)} from fits)"
        for model in models
    ]
    return " union all ".join(parts)


def _predicted(model: str, outcome: int) -> str:
    return f"""{_solve_ctes(model)},
scored_rows as (select samp.*, y.v as actual, yhat as predicted, y.v - yhat as residual
  from samp join pred on samp.i = pred.i and pred.o = {outcome} join y on samp.i = y.i and y.o = {outcome})"""


def predictions(model: str, outcome: int) -> str:
    mediator = rounded("anthropomorphism_score") + "," if model == "full_outcome" else ""
    label = _outcomes(model)[outcome][1]
    return f"""with recursive {_predicted(model, outcome)}
select '{model}' as model, '{label}' as outcome, person_id, {rounded('actual')}, {rounded('predicted')},
  {rounded('residual')}, condition, condition_avatar, {mediator} total_tokens, Sex,
  ethnicity_simplified as "Ethnicity simplified", {rounded('extraversion_score')}, {rounded('agreeableness_score')}
from scored_rows"""


def published_predictions(model: str, outcome: int) -> str:
    even = ", ".join(
        f"round_even({c} * 10000, 0) / 10000 + 0.0 as {c}"
        for c in ("actual", "predicted", "residual", "total_tokens", "extraversion_score", "agreeableness_score")
    )
    label = _outcomes(model)[outcome][1]
    return f"""with recursive {_predicted(model, outcome)}
select '{model}' as model, '{label}' as outcome, person_id, {even}, condition, condition_avatar, Sex,
  ethnicity_simplified as "Ethnicity simplified" from scored_rows"""


def actual_vs_predicted(model: str, outcome: int) -> str:
    label = _outcomes(model)[outcome][1]
    return f"""with recursive {_predicted(model, outcome)}
select '{label}' as outcome, person_id, {rounded('actual')}, {rounded('predicted')} from scored_rows"""


def both_outcomes(query: Callable[[str, int], str], model: str) -> str:
    return " union all ".join(f"(select * from ({query(model, o)}))" for o in range(len(_outcomes(model))))


def prediction_bounds(model: str) -> str:
    parts = [
        f"""(with recursive {_predicted(model, o)} select '{model}' as model, '{label}' as outcome,
  round(least(min(actual), min(predicted)), 6) + 0.0 as low,
  round(greatest(max(actual), max(predicted)), 6) + 0.0 as high from scored_rows)"""
        for o, (_, label) in enumerate(_outcomes(model))
    ]
    return " union all ".join(parts)


def gram(model: str) -> str:
    return f"""with {_design_ctes(model)}
select a.term as row_term, b.term as col_term, round(coalesce(v, 0.0), 6) + 0.0 as value
from terms a cross join terms b left join gram on gram.i = a.k and gram.j = b.k"""


def sample_sizes() -> str:
    parts = [
        f"select '{m}' as model, count(*) filter (where {where})::bigint as n from frame" for m, where in SAMPLES.items()
    ]
    return f"with {FRAME_CTE} {' union all '.join(parts)}"


def survey_scores() -> str:
    scores = ("EMP_Mean", "anthropomorphism_score", "extraversion_score", "agreeableness_score")
    return f"""with {SCORED_CTE} select person_id, condition, condition_avatar, Sex,
  ethnicity_simplified as "Ethnicity simplified", {', '.join(rounded(c) for c in scores)} from scored"""


def survey_csv() -> str:
    scores = ("EMP_Mean", "anthropomorphism_score", "extraversion_score", "agreeableness_score")
    return f"""with {SCORED_CTE} select person_id, condition, Sex, ethnicity_simplified as "Ethnicity simplified",
  {', '.join(rounded(c) for c in scores)} from scored"""


def log_append() -> str:
    return f"""with {NUMBERED_CTE} select event_id, session_id, ArticleID, ResponseID, user_input, bot_response,
  turn_number::bigint as turn_number from numbers"""


def log_stream_append() -> str:
    return f"with {TURN_CTE} select event_id, session_id, ArticleID, ResponseID, user_input, bot_response, response_time from turn"


def log_one_session() -> str:
    return f"{log_stream_append()} where session_id = (select session_id from turn order by event_id desc limit 1)"


def person_tokens() -> str:
    return f"with {TOKENS_CTE} select person_id, total_tokens from tokens"


def analysis_frame() -> str:
    scores = ("EMP_Mean", "anthropomorphism_score", "extraversion_score", "agreeableness_score")
    return f"""with {FRAME_CTE} select person_id, condition, condition_avatar, Sex,
  ethnicity_simplified as "Ethnicity simplified", EMP_1, {', '.join(rounded(c) for c in scores)}, total_tokens from frame"""


def condition_summary(model: str, outcomes: Sequence[str]) -> str:
    parts = [
        f"""select condition, '{y}' as outcome, round(avg({y}), 6) + 0.0 as mean, round(stddev_samp({y}), 6) + 0.0 as std,
  count({y})::bigint as count, round(stddev_samp({y}) / sqrt(count({y})), 6) + 0.0 as sem,
  0::bigint as axis_min, {5 if y == 'anthropomorphism_score' else 7}::bigint as axis_max
from frame where {SAMPLES[model]} group by condition having count({y}) > 1"""
        for y in outcomes
    ]
    return f"with {FRAME_CTE} {' union all '.join(parts)}"


_BY = "partition by session_id order by response_time, event_id"
_COUNTED = "user_input is distinct from '[initial prompt trigger]'"
_USABLE = "coalesce(user_input, '') <> '' and coalesce(bot_response, '') <> ''"

NUMBERED_CTE = f"""{TURN_CTE}, numbered as (
  select *, {_COUNTED} as counted,
    (count(*) filter (where {_COUNTED}) over ({_BY} rows between unbounded preceding and 1 preceding))::bigint as prior_turns
  from turn), numbers as (
  select *, case when counted then prior_turns + 1 else 0 end as turn_number, counted and prior_turns >= 10 as eligible
  from numbered)"""


def session_turn_counts() -> str:
    return f"with {TURN_CTE} select session_id, (count(*) filter (where {_COUNTED}))::bigint as turn_count from turn group by session_id"


def turn_numbers() -> str:
    return f"with {NUMBERED_CTE} select event_id, session_id, turn_number from numbers"


def completion_eligibility() -> str:
    return f"with {NUMBERED_CTE} select event_id, session_id, prior_turns, eligible::bigint as eligible from numbers"


def _coded() -> str:
    return f"""{NUMBERED_CTE}, coded as (
  select *, case when eligible then
    ('0x' || substr(md5(session_id || '#' || turn_number::varchar), 1, 8))::bigint % 10001 end as code from numbers)"""


def _replied(variant: str) -> str:
    extra = "" if variant == "text" else (
        " and not contains(lower(bot_response), 'end') and not contains(lower(bot_response), 'finish')"
    )
    return f"""{_coded()}, replied as (
  select *, case
    when eligible and contains(lower(user_input), 'code')
      then 'Here''s your completion code: ' || code::varchar || '. Thank you for participating in this experiment!'
    when eligible and not contains(lower(bot_response), 'completion code'){extra}
      then bot_response || ' (You can ask for your completion code if you''d like to end the conversation.)'
    else bot_response end as final_reply from coded)"""


def completion_codes() -> str:
    return f"with {_coded()} select event_id, session_id, turn_number, code from coded where eligible"


def final_replies(variant: str) -> str:
    return f"with {_replied(variant)} select event_id, session_id, final_reply from replied"


def issued_codes() -> str:
    return f"""with {_replied('text')} select event_id, session_id, code as issued_code from replied
where final_reply like 'Here''s your completion code: %'"""


def chronological() -> str:
    return f"with {TURN_CTE} select event_id, session_id, row_number() over ({_BY})::bigint as position from turn"


def latest(limit: int) -> str:
    return f"""with {TURN_CTE}, ranked as (
  select *, row_number() over (partition by session_id order by response_time desc, event_id desc) as recency from turn)
select event_id, session_id, recency::bigint as recency, user_input, bot_response from ranked where recency <= {limit} and {_USABLE}"""


def history(variant: str) -> str:
    source = "turn" if variant == "text" else f"(select * from turn where {_USABLE})"
    return f"""with {TURN_CTE}, placed as (
  select *, row_number() over ({_BY}) as position, count(*) over (partition by session_id) as records from {source})
select event_id, session_id, position::bigint as position, user_input, bot_response from placed
where (records <= 50 or position <= 5 or position > records - 45) and {_USABLE}"""


def _sticky(variant: str) -> str:
    asked = "nullif(ArticleID, '')" if variant == "text" else "nullif(nullif(ArticleID, ''), '5')"
    before = f"over ({_BY} rows between unbounded preceding and 1 preceding)"
    return f"""resolved as (
  select *,
    coalesce({asked}, last_value(case when ArticleID not in ('', '5') then ArticleID end ignore nulls) {before}, '5') as article_id,
    coalesce(nullif(ResponseID, ''), last_value(nullif(ResponseID, '') ignore nulls) {before}, '') as response_id
  from turn)"""


def sticky_ids(variant: str) -> str:
    return f"with {TURN_CTE}, {_sticky(variant)} select event_id, session_id, article_id, response_id from resolved"


def input_classes() -> str:
    edge = f"[{_SPACES}]+"
    strip = f"regexp_replace(user_message, '^{edge}|{edge}$', '', 'g')"
    blank = f"coalesce({strip}, '') = ''"
    return f"""with {REQUEST_CTE} select event_id,
  case when {blank} or lower({strip}) = 'page_metadata' then 'welcome' else 'turn' end as text_class,
  case when {blank} or lower(user_message) in ('welcome', 'page_metadata') then 'silent' else 'turn' end as avatar_class,
  {strip} as stripped from request"""


_URL_ARTICLE = "url_decode(replace(nullif(regexp_extract(page_url, '^[^?#]*\\?(?:[^#]*&)?article_id=([^&#]+)', 1), ''), '+', ' '))"


def id_precedence() -> str:
    return f"""with {REQUEST_CTE} select event_id,
  case when coalesce(body_id, '') <> '' then body_id when coalesce(stored_id, '') <> '' then stored_id
    when query_id is not null then query_id when contains(page_url, 'article_id=') then {_URL_ARTICLE} else '5' end as text_article,
  coalesce(query_id, nullif(body_id, ''), {_URL_ARTICLE}, '5') as avatar_article,
  case when coalesce(body_id, '') <> '' then body_id when coalesce(stored_id, '') <> '' then stored_id
    when contains(page_url, 'response_id=') then null else '' end as text_response,
  coalesce(nullif(body_id, ''), '') as avatar_response
from request"""


def _in_url(url: str, name: str) -> str:
    """The first value of a query parameter that is not blank, decoded."""
    found = f"regexp_extract({url}, '^[^?#]*\\?(?:[^#]*&)?{name}=([^&#]+)', 1)"
    return f"url_decode(replace(nullif({found}, ''), '+', ' '))"


def _said(variant: str) -> str:
    """The reply as it is stored, of a request with `message`, `answer`, `number` and `before`."""
    extra = "" if variant == "text" else " and not contains(lower(answer), 'end') and not contains(lower(answer), 'finish')"
    code = "(('0x' || substr(md5(coalesce(session_id, '') || '#' || number::varchar), 1, 8))::bigint % 10001)::varchar"
    return f"""case when before < 10 then answer
    when contains(lower(message), 'code') then 'Here''s your completion code: ' || {code} || '. Thank you for participating in this experiment!'
    when not contains(lower(answer), 'completion code'){extra}
      then answer || ' (You can ask for your completion code if you''d like to end the conversation.)'
    else answer end"""


def requests_to_log(variant: str) -> str:
    """The text chat's memory is replayed request by request in a recursive query; the avatar chat's is a window."""
    failed = "'I''m sorry, I''m having trouble processing your request right now.'"
    edge = f"[{_SPACES}]+"
    earlier = "over (partition by session_id order by request_time, event_id rows between unbounded preceding and 1 preceding)"
    if variant == "text":
        welcome = (
            "'This news describes the tragic death of young Marlins pitcher José Fernández—"
            "what are your thoughts on his life story and the impact he had on others?'"
        )
        own_response = f"case when contains(referer, 'response_id=') then {_in_url('referer', 'response_id')} else '' end"
        own_article = (
            "case when query_article is not null then query_article "
            f"when contains(referer, 'article_id=') then {_in_url('referer', 'article_id')} else '5' end"
        )
        return f"""with recursive request as ({_select(TEXT_REQUESTS, 'events')}),
asked as (
  select event_id, session_id, reply, reply_time, nullif(article_id, '') as body_article, nullif(response_id, '') as body_response,
    {own_article} as own_article, {own_response} as own_response,
    coalesce(regexp_replace(user_message, '^{edge}|{edge}$', '', 'g'), '') as message,
    row_number() over (partition by session_id order by request_time, event_id) as k
  from request),
memory as (
  select session_id, 1::bigint as k, null::varchar as article, null::varchar as response, 0::bigint as before from asked where k = 1
  union all
  select m.session_id, m.k + 1,
    case when coalesce(a.body_article, m.article, a.own_article, '5') <> '5' and coalesce(a.body_article, m.article, a.own_article) <> ''
      then coalesce(a.body_article, m.article, a.own_article) else m.article end,
    case when coalesce(a.body_response, m.response, a.own_response, '') <> '' then coalesce(a.body_response, m.response, a.own_response)
      else m.response end,
    m.before + case when a.message = '' or lower(a.message) = 'page_metadata' or a.message = '[initial prompt trigger]' then 0 else 1 end
  from memory m join asked a on a.session_id = m.session_id and a.k = m.k),
known as (
  select a.*, m.before, m.article, m.response, a.message = '' or lower(a.message) = 'page_metadata' as opens
  from asked a join memory m on a.session_id = m.session_id and a.k = m.k),
answered as (
  select *, case when opens then 0 else before + 1 end as number, coalesce(reply, case when opens then {welcome} else {failed} end) as answer from known)
select event_id, session_id, coalesce(body_article, article, own_article) as "ArticleID",
  coalesce(body_response, response, own_response) as "ResponseID", number::bigint as turn_number,
  case when opens then '[initial prompt trigger]' else message end as user_input, reply_time as user_input_time,
  case when opens then answer else {_said(variant)} end as bot_response, reply_time as response_time
from answered"""

    def found(name: str) -> str:
        params = [f"nullif(json_extract_string(context, '$.{at}queryParams.{name}'), '')" for at in ("", "client.")]
        pages = [
            f"coalesce(nullif(json_extract_string(context, '$.{f}'), ''), json_extract_string(context, '$.client.{f}'))"
            for f in ("pageUrl", "url", "referer")
        ]
        return f"coalesce({', '.join(params + [_in_url(p, name) for p in pages])}, {_in_url('header_referer', name)})"

    return f"""with request as ({_select(AVATAR_REQUESTS, 'events')}),
heard as (
  select *, case when kind = 'session' then nullif({found('article_id')}, '5') end as article,
    case when kind = 'session' then {found('response_id')} end as response
  from request
  where kind = 'session' or (coalesce(regexp_replace(text, '{edge}', '', 'g'), '') <> '' and lower(text) not in ('welcome', 'page_metadata'))),
known as (
  select *, text as message, coalesce(reply, {failed}) as answer,
    coalesce(count(*) filter (where kind = 'execute' and text <> '[initial prompt trigger]') {earlier}, 0) as before,
    coalesce(last_value(article ignore nulls) {earlier}, '5') as known_article,
    coalesce(last_value(response ignore nulls) {earlier}, '') as known_response
  from heard),
numbered as (select *, before + 1 as number from known where kind = 'execute')
select event_id, session_id, known_article as "ArticleID", known_response as "ResponseID", number::bigint as turn_number,
  text as user_input, reply_time as user_input_time, {_said(variant)} as bot_response, reply_time as response_time
from numbered"""


def url_params() -> str:
    def value(name: str) -> str:
        return f"url_decode(replace(nullif(regexp_extract(url, '^[^?#]*\\?(?:[^#]*&)?{name}=([^&#]+)', 1), ''), '+', ' '))"

    return f"""select page_id, {value('page')} as page, {value('ref')} as ref, {value('utm_source')} as utm_source from pages"""


def article_corpus() -> str:
    return """with last as (select doc_id // 2 as k, max(doc_id) as doc_id from documents group by doc_id // 2)
select k::varchar as article_id,
  case when last.doc_id % 10 <> 9 then length(text)::bigint end as chars,
  case when last.doc_id % 10 <> 9 then md5(text) end as text_digest
from last join documents on documents.doc_id = last.doc_id"""


def article_lookup() -> str:
    return f"""with {ARTICLE_CTE} select event_id, cast(event_id % ((select count(*) from documents) + 3) as varchar) as article_id,
  length(substring(coalesce(text, ''), 1, 10000))::bigint as chars, md5(substring(coalesce(text, ''), 1, 10000)) as text_digest
from events left join article on article.article_id = cast(event_id % ((select count(*) from documents) + 3) as varchar)"""


def article_context() -> str:
    return f"""with {ARTICLE_CTE}, {TURN_CTE}, {_sticky('text')}
select event_id, session_id, resolved.article_id,
  length(substring(coalesce(text, ''), 1, 10000))::bigint as chars, md5(substring(coalesce(text, ''), 1, 10000)) as text_digest
from resolved left join article using (article_id)"""


def messages(variant: str, prompt: str) -> str:
    edge = f"[{_SPACES}]+"
    strip = f"regexp_replace(user_input, '^{edge}|{edge}$', '', 'g')"
    if variant == "text":
        entries = "select *, row_number() over (partition by session_id order by response_time, event_id) as place, 1 as one from turn"
        number, keep_turn = "", "true"
        current = f"""case when user_input = '[initial prompt trigger]' or coalesce({strip}, '') in ('', 'page_metadata')
      then 'welcome' else {strip} end"""
    else:
        entries = f"""select *, row_number() over (partition by session_id order by response_time, event_id) as place, 1 as one
      from turn where {_USABLE}"""
        number = """union all
  select event_id, 1, 'system', 'Current conversation turn: ' || (prior_turns + 1)::varchar from prompted"""
        keep_turn = f"coalesce({strip}, '') <> '' and lower(user_input) not in ('welcome', 'page_metadata')"
        current = "user_input"
    return f"""with {ARTICLE_CTE}, {NUMBERED_CTE}, {_sticky(variant)}, entry as ({entries}),
prior as (
  select n.event_id, count(e.event_id) as entries from numbers n left join entry e
    on e.session_id = n.session_id and (e.response_time, e.event_id) < (n.response_time, n.event_id) group by n.event_id),
prompted as (
  select n.*, r.article_id, p.entries from numbers n join resolved r on r.event_id = n.event_id
    join prior p on p.event_id = n.event_id where {keep_turn.replace('user_input', 'n.user_input')}),
part(event_id, place, role, content) as (
  select event_id, 0, 'system', '{prompt}' from prompted {number} union all
  select event_id, 2, 'system', '{S.ARTICLE_PREFACE[variant].rstrip()}' || chr(10) || chr(10) || substring(a.text, 1, 10000)
    from prompted join article a using (article_id) where a.text <> '' union all
  select p.event_id, 10 * e.place, 'user', e.user_input from prompted p join entry e
    on e.session_id = p.session_id and e.place <= p.entries and (p.entries <= 50 or e.place <= 5 or e.place > p.entries - 45)
    where coalesce(e.user_input, '') <> '' and coalesce(e.bot_response, '') <> '' union all
  select p.event_id, 10 * e.place + 1, 'assistant', e.bot_response from prompted p join entry e
    on e.session_id = p.session_id and e.place <= p.entries and (p.entries <= 50 or e.place <= 5 or e.place > p.entries - 45)
    where coalesce(e.user_input, '') <> '' and coalesce(e.bot_response, '') <> '' union all
  select event_id, 1000000000, 'user', {current} from prompted)
select event_id, count(*)::bigint as messages, md5(string_agg(role || ':' || content, chr(10) order by place)) as digest
from part group by event_id"""


def log_to_utterances() -> str:
    return f"""with {TURN_CTE} select nullif(ResponseID, '') as person_id, user_input as text from turn
union all select nullif(ResponseID, ''), bot_response from turn"""


def log_export() -> str:
    return f"""with {TURN_CTE} select event_id::varchar as _id, session_id, ArticleID, ResponseID, user_input, bot_response,
  strftime(response_time, '%Y-%m-%d %H:%M:%S.%f') as response_time from turn"""


def log_csv() -> str:
    """A CSV cell that is empty is a missing one."""
    texts = ", ".join(f"nullif({c}, '') as {c}" for c in ("ArticleID", "ResponseID", "user_input", "bot_response"))
    return f"select _id, session_id, {texts}, response_time from ({log_export()})"


def log_preview() -> str:
    return f"with log as ({log_export()}) select * from log order by response_time, _id limit 5"


def utterance_tokens_from_log() -> str:
    return f"""with {TURN_CTE}, side as (
  select ResponseID as person_id, user_input as text from turn union all select ResponseID, bot_response from turn)
select person_id, sum(coalesce(len(regexp_extract_all(text, '[^{_SPACES}]+')), 0))::bigint as total_tokens
from side where person_id <> '' group by person_id"""


def stream_follow(variant: str) -> str:
    return f"""with {NUMBERED_CTE}, {_sticky(variant)}
select n.event_id, n.session_id, n.turn_number, n.eligible::bigint as eligible, r.article_id, r.response_id
from numbers n join resolved r on r.event_id = n.event_id"""
