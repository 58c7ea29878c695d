"""Preference formatting: chosen and rejected conversations to one prompt and two masked completions.

The longest common prefix of turns (same role and text, in order) is rendered once as the prompt; what follows it in
each conversation is a completion. `*_mask` marks, in each completion, the character ranges the loss counts: the texts of
assistant turns with their closing mark. All in DataFrame expressions; the common prefix is found inside one row per pair.

Turns are ordered by (turn, role, text); a null role or text is an empty one. Defined cases: a pair whose conversations
are equal has empty completions; one without any turn on one side keeps the other's turns as completion; repeated turns
stay; rows without conversation id are no conversation; turns with one place come in the order of role and text; very long
texts and conversations are rendered whole; empty tables give no rows; extra columns are ignored (kept by `preferences`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the rendered format.
CLOSE = "<|end|>\n"

TURNS = 64  # turns whose lengths are summed at once


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns: array of (turn, role, text)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('<|', t.role, '|>\\n', t.text, '{CLOSE.strip()}\\n')), '')"


def masked(turns: str) -> str:
    """SQL: (start, stop) of the assistants' texts in the rendered turns, closing marks included."""
    head, tail = "length(t.role) + 5", "length(t.text) + 8"
    total = "aggregate({}, 0, (a, x) -> a + x)"
    # offsets are running sums by blocks: linear in the turns
    blocks = f"aggregate(sequence(1, greatest(1, cast(ceil(size(n) / {TURNS}D) as int))), array(0), (a, k) -> concat(a, array(element_at(a, -1) + {total.format(f'slice(n, (k - 1) * {TURNS} + 1, {TURNS})')})))"
    at = f"o[i div {TURNS}] + {total.format(f'slice(n, (i div {TURNS}) * {TURNS} + 1, i % {TURNS})')}".replace(f"i div {TURNS}", f"cast(i div {TURNS} as int)").replace(f"i % {TURNS}", f"cast(i % {TURNS} as int)")
    placed = f"transform(array({turns}), v -> transform(array(transform(v, t -> {head} + {tail})), n -> transform(array({blocks}), o -> transform(v, (t, i) -> named_struct('t', t, 'at', {at})))))[0][0][0]"
    return (
        f"transform(filter({placed}, m -> m.t.role = 'assistant'),"
        " m -> named_struct('start', m.at + length(m.t.role) + 5, 'stop', m.at + length(m.t.role) + 5 + length(m.t.text) + 7))"
    )


def preferences(pairs: DataFrame) -> DataFrame:
    """pairs (chosen and rejected: arrays of turns) with prompt, common, and completion, mask of either side."""
    same = "chosen[i].role = rejected[i].role and chosen[i].text = rejected[i].text"
    steps = "case when least(size(chosen), size(rejected)) > 0 then sequence(0, least(size(chosen), size(rejected)) - 1) else array() end"
    common = F.expr(f"aggregate({steps}, 0, (n, i) -> case when n = i and {same} then n + 1 else n end)")
    out = pairs.withColumn("common", common)
    rest = lambda side: f"slice({side}, common + 1, size({side}))"
    return out.select(
        *[c for c in pairs.columns if c not in ("chosen", "rejected")], F.col("common").cast("long").alias("common"), F.expr(rendered("slice(chosen, 1, common)")).alias("prompt"),
        *[F.expr(f(rest(side))).alias(f"{side}_{name}") for side in ("chosen", "rejected") for f, name in ((rendered, "completion"), (masked, "mask"))],
    )


def swapped(talks: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: the rejected side ends with the last turn of another one.

    The other conversation is the next id; where there is none, the reply is empty. Only conversations that end with an
    assistant's turn make a pair. An equi-join of ids, so nothing is gathered.
    """
    last = talks.select((F.col("conv_id") - 1).alias("conv_id"), F.element_at("turns", -1)["text"].alias("other"))
    ends = talks.filter("element_at(turns, -1).role = 'assistant'").join(last, "conv_id", "left")
    reply = "concat(slice(turns, 1, size(turns) - 1), array(named_struct('turn', element_at(turns, -1).turn, 'role', 'assistant', 'text', coalesce(other, ''))))"
    return ends.select("conv_id", F.col("turns").alias("chosen"), F.expr(reply).alias("rejected"))


def digest(formatted: DataFrame) -> DataFrame:
    span = lambda c: F.expr(f"array_join(transform({c}, m -> concat(m.start, ':', m.stop)), ',')")
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    columns: list[Column] = [F.col("conv_id"), F.col("common"), F.length("prompt").cast("long").alias("prompt_chars"), md5("prompt").alias("prompt_md5")]
    for side in ("chosen", "rejected"):
        columns += [md5(f"{side}_completion").alias(f"{side}_md5"), span(f"{side}_mask").alias(f"{side}_mask")]
    return formatted.select(columns)


ORACLE = """
with c as (select conv_id, list({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn, coalesce(role, ''), coalesce(text, '')) t from conversations where conv_id is not null group by conv_id),
p as (select a.conv_id, a.t chosen, list_concat(a.t[1:-2], [{'turn': a.t[-1].turn, 'role': 'assistant', 'text': coalesce(b.t[-1].text, '')}]) rejected from c a left join c b on b.conv_id = a.conv_id + 1 where a.t[-1].role = 'assistant'),
q as (select *, coalesce((select min(i) - 1 from range(1, len(chosen) + 1) r(i) where chosen[i].role <> rejected[i].role or chosen[i].text <> rejected[i].text), len(chosen)) common from p),
s as (select conv_id, common, chosen[1:common] head, chosen[common + 1:] x, rejected[common + 1:] y from q),
r as (select conv_id, common, array_to_string(list_transform(head, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') prompt,
  array_to_string(list_transform(x, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') cx, array_to_string(list_transform(y, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') cy, x, y from s)
select conv_id, common::bigint common, length(prompt)::bigint prompt_chars, md5(prompt) prompt_md5, md5(cx) chosen_md5,
  array_to_string(list_filter(list_transform(x, lambda t, i: case when t.role = 'assistant' then (coalesce(list_sum(list_transform(x[1:i - 1], lambda v: length(v.role) + length(v.text) + 13)), 0)::bigint + length(t.role) + 5)::varchar || ':' || (coalesce(list_sum(list_transform(x[1:i - 1], lambda v: length(v.role) + length(v.text) + 13)), 0)::bigint + length(t.role) + 5 + length(t.text) + 7)::varchar end), lambda v: v is not null), ',') chosen_mask,
  md5(cy) rejected_md5,
  array_to_string(list_filter(list_transform(y, lambda t, i: case when t.role = 'assistant' then (coalesce(list_sum(list_transform(y[1:i - 1], lambda v: length(v.role) + length(v.text) + 13)), 0)::bigint + length(t.role) + 5)::varchar || ':' || (coalesce(list_sum(list_transform(y[1:i - 1], lambda v: length(v.role) + length(v.text) + 13)), 0)::bigint + length(t.role) + 5 + length(t.text) + 7)::varchar end), lambda v: v is not null), ',') rejected_mask
from r
"""
