r"""Personal data by candidate gradient boosting, in DataFrame expressions only.

1. Strict rules give the base spans of four kinds: leftmost, non-overlapping, then validated (octets, Luhn, digit counts).
2. Loose generators propose overlapping candidates: spelled-out addresses, four numbers between dots or spelled-out dots
   as ip, and every part of a digit run that begins and ends at its separators and has 7 to 19 digits, as card and phone.
3. A candidate that satisfies the strict rule of its kind is a positive label. The trees see its format and its
   context but never the cue the rule keys on (the plus sign, the check digit, the at sign), so what they learn carries
   over to spans that lack the cue. Features are small integers: all candidates of the corpus collapse to a table of
   feature cells, at most CELLS rows, on which the trees are boosted; nothing is sampled.
4. Per kind, the lowest score whose precision on the held-out fold of documents reaches PRECISION becomes the
   threshold; candidates above it are added to the base spans, which always stay.

Positions are code points, end exclusive. Defined cases: a null text is an empty one and has no span; repeated rows are
treated each by itself; an empty table, or one without candidates, gives a model that adds nothing; other columns of the
input pass through `redact` unchanged, whatever their names; rows without doc_id are treated like others; overlapping
candidates may all be added; very long texts are read whole.

All patterns are linear: where a scan could restart inside a run, a look-behind (or the end of the previous match)
pins the start of the run, and quantifiers are possessive wherever giving back could not help.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy_shuffles, written

KINDS = ("email", "ip", "card", "phone")

# The strict patterns of the four kinds (linear forms of the plain ones in the comments).
STRICT = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for the strict pattern to be worth a scan.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# Loose generators.
LOOSE_MAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]++)++"
_DOT = r"(?:\x20?(?:[.]|\(dot\)|\[dot\])\x20?|\x20dot\x20)"
LOOSE_IP = r"(?:\G|(?<![0-9]))[0-9]++" + (_DOT + "[0-9]++") * 3
LOOSE_DIGITS = r"[+]?[(]?[0-9](?:[\x20().-]?+[\x20().-]?+[0-9])++"

# Context words: fixed values.
CONTEXT = (("mail|contact|address", 1), ("phone|tel|call|mobile|fax", 2), ("card|visa|credit|pay|account", 3), ("host|server|addr", 4))

FEATURES = ("kind", "digits", "style", "groups", "prev", "next", "context")
LEVELS = (4, 21, 6, 7, 5, 5, 5)
CELLS = math.prod(LEVELS) * 4  # with label and fold: the proven bound of what reaches the driver
TREES, DEPTH, RATE, L2 = 24, 3, 0.3, 1.0
PRECISION, SUPPORT, FOLDS = 0.98, 20, 5
BLOCK = 256


def quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def located(pattern: str, hint: str | None = None) -> str:
    """SQL: array of (start, stop, m, before, after) of the matches of pattern in column `t`.

    Gaps and matches alternate, so offsets are running sums of lengths; sums are taken by blocks, which keeps texts
    with very many matches linear.
    """
    gaps, found = f"split(t, {quoted(pattern)}, -1)", f"regexp_extract_all(t, {quoted(pattern)}, 0)"
    empty = "cast(array() as array<struct<start:bigint,stop:bigint,m:string,before:string,after:string>>)"
    total = "aggregate({}, 0L, (a, x) -> a + x)"
    body = (
        "transform(array({g}), g -> transform(array({m}), m -> transform(array(transform(m, (x, i) -> cast(length(g[i]) + length(x) as bigint))), n ->"
        " transform(array(aggregate(sequence(1, cast(ceil(size(n) / {b}D) as int)), array(0L), (a, k) -> concat(a, array(element_at(a, -1) + {block})))), o ->"
        " transform(m, (x, i) -> named_struct('start', o[cast(i div {b} as int)] + {inside} + length(g[i]), 'stop', o[cast(i div {b} as int)] + {inside} + n[i], 'm', x,"
        " 'before', substring(g[i], -24, 24), 'after', substring(g[i + 1], 1, 1)))))))[0][0][0][0]"
    ).format(
        g=gaps, m=found, b=BLOCK,
        block=total.format(f"slice(n, (k - 1) * {BLOCK} + 1, {BLOCK})"),
        inside=total.format(f"slice(n, cast(i div {BLOCK} as int) * {BLOCK} + 1, cast(i % {BLOCK} as int))"),
    )
    some = f"contains(t, '{hint}') and " if hint else ""
    return f"case when {some}size({gaps}) > 1 then {body} else {empty} end"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(d: str) -> str:
    """SQL: whether the digits d pass the check-digit rule."""
    twice = f"(2 * (ascii(substring({d}, length({d}) - i, 1)) - 48))"
    return (
        f"aggregate(sequence(0, length({d}) - 1), 0, (a, i) -> a + case when i % 2 = 0 then ascii(substring({d}, length({d}) - i, 1)) - 48"
        f" when {twice} > 9 then {twice} - 9 else {twice} end) % 10 = 0"
    )


VALID = {
    "email": "true",
    "ip": "forall(split(s.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', ltrim('0', p)) as int) <= 255)",
    "card": f"case when length({digits('s.m')}) between 16 and 19 then {luhn(digits('s.m'))} else false end",
    "phone": f"length({digits('s.m')}) between 8 and 15",
}


def char_class(c: str) -> str:
    return f"case when {c} = '' then 0 when {c} rlike '[\\\\x20\\\\x09-\\\\x0D]' then 1 when {c} rlike '[A-Za-z]' then 2 when {c} rlike '[0-9]' then 3 else 4 end"


def described(kind: int, strict: str) -> str:
    """SQL lambda body: candidate s with its features and its label."""
    m = "s.m"
    style = (
        f"case when {m} rlike '[()]' then 4 when {m} rlike '[0-9]\\\\x20' and {m} rlike '[0-9][.-]' then 5 when {m} rlike '[0-9]\\\\x20' then 1"
        f" when {m} rlike '[0-9]-' then 2 when {m} rlike '[0-9][.]' then 3 else 0 end"
    )
    before = "lower(s.before)"
    context = "case " + " ".join(f"when {before} rlike '{w}' then {v}" for w, v in CONTEXT) + " else 0 end"
    prev = char_class("substring(s.before, -1, 1)")
    return (
        f"named_struct('start', s.start, 'stop', s.stop, 'kind', {kind}, 'digits', least(length({digits(m)}), 20), 'style', {style},"
        f" 'groups', least(size(split(trim(regexp_replace({m}, '[^0-9]+', ' ')), ' ')), 6), 'prev', {prev}, 'next', {char_class('s.after')},"
        f" 'context', {context}, 'label', case when {strict} then 1 else 0 end)"
    )


MOST = 19  # digits of a candidate at most, so groups of one at most


def sub_spans(runs: str) -> str:
    """SQL: the parts of digit runs that begin and end at separator groups and have 7 to MOST digits.

    A group has a digit at least, so at most MOST parts begin at each: linear in the run.
    """
    groups = located("[+]?[(]?[0-9]+").replace("(t, ", "(r.m, ")
    m = "substring(r.m, cast(g[i].start + 1 as int), cast(g[j].stop - g[i].start as int))"
    before = "right(concat(r.before, substring(r.m, greatest(1, cast(g[i].start as int) - 23), least(24, cast(g[i].start as int)))), 24)"
    after = "case when g[j].stop < length(r.m) then substring(r.m, cast(g[j].stop + 1 as int), 1) else r.after end"
    one = f"named_struct('start', r.start + g[i].start, 'stop', r.start + g[j].stop, 'm', {m}, 'before', {before}, 'after', {after})"
    ends = f"filter(sequence(i, least(i + {MOST}, size(g)) - 1), j -> length({digits(m)}) between 7 and {MOST})"
    return f"flatten(transform({runs}, r -> transform(array({groups}), g -> flatten(transform(sequence(0, size(g) - 1), i -> transform({ends}, j -> {one}))))[0]))"


def annotate(docs: DataFrame) -> DataFrame:
    """docs with `base` (struct of span arrays by kind) and `candidates` (array of described spans)."""
    t = docs.withColumn("t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = ", ".join(f"'{k}', transform(filter({located(STRICT[k], HINT[k])}, s -> {VALID[k]}), s -> named_struct('start', s.start, 'stop', s.stop))" for k in KINDS)
    full = {k: f"regexp_like(s.m, {quoted('^(?:' + STRICT[k] + ')$')}) and {VALID[k]}" for k in KINDS}
    n = f"length({digits('s.m')})"
    runs = sub_spans(f"filter({located(LOOSE_DIGITS)}, s -> {n} >= 7)")
    proposals = (
        f"concat(transform({located(LOOSE_MAIL)}, s -> {described(0, full['email'])}),"
        f" transform({located(LOOSE_IP)}, s -> {described(1, full['ip'])}),"
        f" transform(array({runs}), q -> concat("
        f"transform(filter(q, s -> {n} >= 13), s -> {described(2, full['card'])}),"
        f"transform(filter(q, s -> {n} <= 15), s -> {described(3, full['phone'])})))[0])"
    )
    return t.withColumn("base", F.expr(f"named_struct({base})")).withColumn("candidates", F.expr(proposals)).drop("t")


def cells(annotated: DataFrame) -> list:
    """Counts of candidates by features, label and fold: at most CELLS rows, whatever the corpus holds."""
    fold = F.when(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(FOLDS)) == 0, 1).otherwise(0)
    each = annotated.filter(F.size("candidates") > 0).select(fold.alias("fold"), F.explode("candidates").alias("c"))
    return each.groupBy("fold", *[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.label").alias("label")).count().collect()


def boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list:
    """Logistic gradient boosting over weighted cells: trees as nested (feature, cut, left, right) or leaf values."""

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = float(g[rows].sum() / (h[rows].sum() + L2) * RATE)
        if depth == 0 or len(rows) < 2:
            return leaf
        best, total_g, total_h = (1e-6, None, None), g[rows].sum(), h[rows].sum()
        for f, levels in enumerate(LEVELS):
            gs = np.cumsum(np.bincount(x[rows, f], weights=g[rows], minlength=levels))
            hs = np.cumsum(np.bincount(x[rows, f], weights=h[rows], minlength=levels))
            gain = gs**2 / (hs + L2) + (total_g - gs) ** 2 / (total_h - hs + L2) - total_g**2 / (total_h + L2)
            gain[(hs <= 0) | (hs >= total_h)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] is None:
            return leaf
        _, f, k = best
        low = x[rows, f] <= k
        return (f, k, grow(rows[low], g, h, depth - 1), grow(rows[~low], g, h, depth - 1))

    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), w * (y - p), w * p * (1 - p), DEPTH))
        score += np.array([value(trees[-1], r) for r in x])
    return trees


def value(tree, row) -> float:
    while isinstance(tree, tuple):
        f, k, low, high = tree
        tree = low if row[f] <= k else high
    return tree


def fit(annotated: DataFrame) -> dict:
    """Trees and the threshold of each kind (infinite where nothing qualifies)."""
    rows = cells(annotated)
    model = {"trees": [], "cut": dict.fromkeys(range(len(KINDS)), math.inf)}
    rows.sort(key=tuple)
    held = np.array([r["fold"] == 1 for r in rows], bool)
    x = np.array([[r[f] for f in FEATURES] for r in rows], np.int64).reshape(len(rows), len(FEATURES))
    y, w = np.array([r["label"] for r in rows], float), np.array([r["count"] for r in rows], float)
    if not (~held).any() or y.sum() == 0:
        return model
    model["trees"] = boosted(x[~held], y[~held], w[~held])
    score = np.array([sum(value(t, r) for t in model["trees"]) for r in x])
    for kind in range(len(KINDS)):
        mine = held & (x[:, 0] == kind)
        order = np.argsort(-score[mine], kind="stable")
        s, hits, all_ = score[mine][order], np.cumsum((y * w)[mine][order]), np.cumsum(w[mine][order])
        last = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
        good = last & (hits >= PRECISION * all_) & (all_ >= SUPPORT)
        if good.any():
            model["cut"][kind] = float(s[np.nonzero(good)[0][-1]])
    return model


def tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, k, low, high = tree
    return f"case when c.{FEATURES[f]} <= {k} then {tree_sql(low)} else {tree_sql(high)} end"


def selected(annotated: DataFrame, model: dict) -> DataFrame:
    """annotated with `found`: the base spans of each kind and the added ones, by start."""
    parts = []
    for i, kind in enumerate(KINDS):
        cut = model["cut"][i]
        if math.isinf(cut):
            parts.append(f"'{kind}', base.{kind}")
            continue
        # the first base span that ends after the candidate starts, by bisection; it overlaps if it starts before the candidate's end
        at = (
            f"aggregate(sequence(1, 32), named_struct('lo', 0, 'hi', size(base.{kind})), (a, _) -> case when a.lo >= a.hi then a"
            f" when base.{kind}[cast((a.lo + a.hi) div 2 as int)].stop > c.start then named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int))"
            f" else named_struct('lo', cast((a.lo + a.hi) div 2 + 1 as int), 'hi', a.hi) end, a -> a.lo)"
        )
        clear = f"coalesce(get(base.{kind}, {at}).start >= c.stop, true)"
        score = " + ".join(f"({tree_sql(t)})" for t in model["trees"])
        added = f"transform(filter(candidates, c -> c.kind = {i} and ({score}) >= {cut!r}D - 1e-9D and {clear}), c -> named_struct('start', c.start, 'stop', c.stop))"
        parts.append(f"'{kind}', array_sort(concat(base.{kind}, {added}))")
    return annotated.withColumn("found", F.expr(f"named_struct({', '.join(parts)})"))


def listed(column: str) -> Column:
    """kind:start:end of a struct of span arrays, comma-joined."""
    each = ", ".join(f"transform({column}.{k}, s -> concat('{k}:', s.start, ':', s.stop))" for k in KINDS)
    return F.expr(f"array_join(concat({each}), ',')")


def digest(found: DataFrame) -> DataFrame:
    counts = [F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"))


PIECE = 4096  # code points of the pieces that long texts are cut into before spans are taken out


def between(a: str, z: str) -> str:
    """SQL: code points a to z of the text cut into `pieces`."""
    x, y = f"cast({a} div {PIECE} as int)", f"cast({z} div {PIECE} as int)"
    head, tail = f"cast({a} % {PIECE} as int) + 1", f"cast({z} % {PIECE} as int)"
    return (
        f"case when {x} = {y} then substring(coalesce(get(pieces, {x}), ''), {head}, cast({z} - {a} as int))"
        f" else concat(substring(coalesce(get(pieces, {x}), ''), {head}), array_join(slice(pieces, {x} + 2, {y} - {x} - 1), ''), substring(coalesce(get(pieces, {y}), ''), 1, {tail})) end"
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans merge, the first names them.

    All columns pass as one struct, so no name clashes. Linear in the text and in its spans: how far the spans before each
    one reach is a running maximum by blocks, and what lies between spans comes from short pieces of the text.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    with tidy_shuffles(spark):
        annotated = written(annotate(rows).select("doc_id", "row", "base", "candidates"), "annotated")
        found = selected(annotated, fit(annotated))
    tagged = "array_sort(concat(" + ", ".join(f"transform(found.{k}, s -> named_struct('start', s.start, 'stop', s.stop, 'kind', '{k}'))" for k in KINDS) + "))"
    top = "aggregate({}, 0L, (m, x) -> greatest(m, x.stop))"
    block = "cast(i div {b} as int)".format(b=BLOCK)
    tops = f"aggregate(sequence(1, cast(ceil(size(spans) / {BLOCK}D) as int)), array(0L), (a, k) -> concat(a, array(greatest(element_at(a, -1), {top.format(f'slice(spans, (k - 1) * {BLOCK} + 1, {BLOCK})')}))))"
    before = f"greatest(tops[{block}], {top.format(f'slice(spans, {block} * {BLOCK} + 1, cast(i % {BLOCK} as int))')})"
    marks = f"transform(spans, (s, i) -> transform(array({before}), m -> case when s.start >= m then concat({between('m', 's.start')}, '[', upper(s.kind), ']') else '' end)[0])"
    n = "cast(length(row.text) as bigint)"
    text = f"concat(array_join({marks}, ''), {between('element_at(tops, -1)', n)})"
    out = found.select("row", F.expr(tagged).alias("spans"))
    out = out.withColumn("tops", F.expr(f"case when size(spans) > 0 then {tops} end"))
    out = out.withColumn("pieces", F.expr(f"case when size(spans) > 0 then regexp_extract_all(row.text, r'(?s).{{1,{PIECE}}}', 0) end"))
    text = F.expr(f"case when size(spans) > 0 then {text} else row.text end")
    return out.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
