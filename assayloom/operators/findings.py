"""Findings: documents with front matter, their graph, and the integrity rules as set-based validation queries.

A frame of documents has `path` and `content`. Rules that need a whole document (closed front matter and a body that is
not blank) pass over others. All of it is DataFrame expressions; a violation query returns every violation, and
`first_violation` the one a guard that checks in order would report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States, edge types, the states that mean a finding has fallen.
STATES = ("candidate", "under_exploration", "validated", "invalidated", "superseded", "closed")
EDGES = ("supports", "refines", "contradicts", "supersedes", "closes", "relates_to")
FALLEN = ("invalidated", "superseded")
DEPENDENT = ("supports", "refines", "closes")

FRONT = r"(?s)^﻿?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)(.*)$"
SHOWN = r"!\[(?:[^\]\\]|\\.)*+\]\(\s*+(<[^>]*+>[^)]*+|[^)]++)\)"  # Markdown: a bracketed caption, then the target, in angle brackets or plain
EMBEDDED = [rf"(?i)<img\b[^>]*?\bsrc\s*+=\s*+{q}([^{q}]++){q}" for q in ('"', "'")]  # HTML, in either kind of quotes
MENTION = r"(?i)(?<!\w)finding(?:s)?\s++(?:#)?(\d{4})(?!\w)"  # a finding is cited by its four-digit number
LINK_TEXT, LINK_TARGET = r"\[([^\]]*)\]\([^)]+\)", r"\[[^\]]*\]\(([^)]+)\)"
# Kinds of figures, and how many folders (least, most) lie between the kind's and the file.
LAYOUT = {"metadata": (1, 2), "qc": (1, 2), "analysis": (2, 2)}


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def field(name: str) -> Column:
    """A scalar field of the front matter, quotes gone; null where absent."""
    raw = F.trim(F.regexp_extract("front", rf"(?m)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1))
    return F.nullif(F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2"), F.lit(""))


def relative(target: Column) -> Column:
    """A figure path below figures/, or null: slashes, query, fragment, %-escapes and dot segments resolved."""
    bare = F.regexp_replace(F.trim(target), r"""^<([^>]*)>.*$|^(\S+)\s+["'(].*$""", "$1$2")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\\", "/"), r"[?#].*$", "")
    # escapes of a bad form stay; "+" is a plus
    plain = F.regexp_replace(F.regexp_replace(bare, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    decoded = F.coalesce(F.try_url_decode(plain), bare)
    parts = F.filter(F.split(decoded, "/"), lambda p: (p != "") & (p != "."))
    solid = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))
    path = F.array_join(solid, "/")
    absolute = decoded.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|/)")
    return F.when(path.startswith("figures/") & ~absolute, path)


def laid_out(path: Column) -> Column:
    """Whether a figure lies as deep below the folder of its kind as LAYOUT has it."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 3
    kinds = [(F.get(parts, F.lit(1)) == kind) & depth.between(least, most) for kind, (least, most) in LAYOUT.items()]
    return (F.get(parts, F.lit(0)) == "figures") & F.coalesce(reduce(lambda a, b: a | b, kinds), F.lit(False)) & ~F.exists(parts, lambda x: x == "")


def parsed(docs: DataFrame) -> DataFrame:
    """docs with the parts of each document: front matter fields, listed and shown figures, mentions and links."""
    p = docs.withColumn("front", F.regexp_extract("content", FRONT, 1)).withColumn("body", F.regexp_extract("content", FRONT, 2))
    p = p.withColumn("complete", (F.col("front") != "") & (F.trim(F.regexp_replace("body", r"\s+", " ")) != ""))
    for name in ("title", "status", "phase", "kind", "summary", "verdict", "script", "commit", "data_version"):
        p = p.withColumn(name, field(name) if name not in ("script", "commit", "data_version") else F.nullif(F.trim(F.regexp_replace(F.regexp_extract("front", rf"(?m)^[ \t]*{name}:[ \t]*(.*?)[ \t]*\r?$", 1), "[\"']", "")), F.lit("")))
    number = F.regexp_extract("front", r"""(?m)^[ \t]*id:[ \t]*["']?([0-9]+)""", 1)
    p = p.withColumn("id", F.when(number != "", number.cast("int"))).withColumn("integrity_signoff", F.coalesce(F.lower(field("integrity_signoff")) == "true", F.lit(False)))
    quoted = r"""(?m)^[ \t{,-]*(?<![A-Za-z_])%s:[ \t]*["']?([^"'\s,}]+)"""
    p = p.withColumn("listed", all_of(F.col("front"), quoted % "png")).withColumn("listed_legends", all_of(F.col("front"), quoted % "legend_png"))
    p = p.withColumn("shown", F.array_distinct(F.concat(*[all_of(F.col("body"), pattern) for pattern in (SHOWN, *EMBEDDED)])))
    p = p.withColumn("mentions", F.array_distinct(all_of(F.col("body"), MENTION)))
    links = F.arrays_zip(all_of(F.col("body"), LINK_TEXT).alias("text"), all_of(F.col("body"), LINK_TARGET).alias("target"))
    p = p.withColumn("links", links)
    edges = F.arrays_zip(all_of(F.col("front"), r"\{[ \t]*type:[ \t]*([a-z_]+)[ \t]*,[ \t]*target:[ \t]*[0-9]+").alias("type"), all_of(F.col("front"), r"\{[ \t]*type:[ \t]*[a-z_]+[ \t]*,[ \t]*target:[ \t]*([0-9]+)").alias("target"))
    return p.withColumn("edges", F.transform(edges, lambda e: F.struct(e["type"].alias("type"), e["target"].cast("int").alias("target"))))


def violations(p: DataFrame, gate_passed: bool = False, structured: bool = False) -> DataFrame:
    """path, id, rule (1-7, in a guard's order) and detail of every violation of parsed documents."""
    norm = lambda a: F.transform(a, relative)
    known = lambda a: F.filter(norm(a), lambda x: x.isNotNull())
    is_legend = lambda r: r.endswith(".legend.png")
    shown, whole = known(F.col("shown")), F.col("complete")
    none = F.array().cast("array<string>")
    flag = lambda cond, text: F.when(cond, F.array(F.lit(text))).otherwise(none)
    validated = F.coalesce(F.col("status") == "validated", F.lit(False))
    own = F.format_string("%04d", F.col("id"))  # not cut: 10000 is not finding 1000
    base = lambda link: F.element_at(F.split(F.regexp_replace(link["target"], r"\\", "/"), "/"), -1)
    credited = F.flatten(F.transform("links", lambda k: F.concat(F.filter(F.regexp_extract_all(k["text"], F.lit(MENTION), F.lit(1)), lambda m: base(k).startswith(m)), F.filter(F.array(F.substring(base(k), 1, 4)), lambda b: b.rlike("^[0-9]{4}$") & F.contains(k["text"], b)))))
    at = lambda figures, only: F.filter(figures, only)
    paths = F.array_distinct(known(F.concat("listed", "listed_legends", "shown")))
    rules = [
        flag((validated | F.col("integrity_signoff")) & F.lit(not gate_passed), "sign-off before the integrity gate"),
        flag(validated & ~F.coalesce(F.col("script").rlike(r"(^|/)scripts/"), F.lit(False)), "validated without a promoted script"),
        F.filter("listed", lambda x: ~F.coalesce(F.array_contains(shown, relative(x)), F.lit(False))),
        at(F.array_except(shown, known(F.col("listed"))), lambda r: ~is_legend(r)),
        F.filter(F.array_except("mentions", credited), lambda m: ~F.coalesce(m == own, F.lit(False))),
        F.concat(F.filter("listed_legends", lambda x: ~F.coalesce(F.array_contains(shown, relative(x)), F.lit(False))), at(F.array_except(shown, known(F.col("listed_legends"))), is_legend)),
        F.filter(paths, lambda r: ~laid_out(r)) if structured else none,
    ]
    numbered = lambda details, rule: F.transform(details, lambda d: F.struct(F.lit(rule).alias("rule"), d.alias("detail")))
    parts = [numbered(F.when(whole, r).otherwise(none) if i > 1 else r, i + 1) for i, r in enumerate(rules)]
    return p.select("path", "id", F.explode(F.concat(*parts)).alias("v")).select("path", "id", "v.rule", "v.detail")


def first_violation(v: DataFrame) -> DataFrame:
    return v.groupBy("path", "id").agg(F.min(F.struct("rule", "detail")).alias("m")).select("path", "id", "m.rule", "m.detail")


def edges(p: DataFrame) -> DataFrame:
    """src, type, dst of every edge with a known type."""
    return p.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select("src", "e.type", F.col("e.target").alias("dst")).filter(F.col("type").isin(*EDGES))


def reverse_edges(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.concat(F.lit("inverse_"), "type").alias("type"), F.col("src").alias("dst"))


def dangling(e: DataFrame, p: DataFrame) -> DataFrame:
    return e.join(p.select(F.col("id").alias("dst")), "dst", "left_anti")


def superseded(e: DataFrame, p: DataFrame) -> DataFrame:
    """Findings with their status after the supersedes edges took effect."""
    gone = e.filter("type = 'supersedes'").select(F.col("dst").alias("id")).distinct().withColumn("_s", F.lit("superseded"))
    return p.select("id", "status").join(gone, "id", "left").select("id", F.coalesce("_s", "status").alias("status"))


def cascade(e: DataFrame, p: DataFrame) -> DataFrame:
    """Findings to review: those with a supports, refines or closes edge to a fallen one."""
    fallen = p.filter(F.col("status").isin(*FALLEN)).select(F.col("id").alias("dst"))
    return e.filter(F.col("type").isin(*DEPENDENT)).join(fallen, "dst").select(F.col("src").alias("id"), F.col("dst").alias("because_of"), "type").distinct()


def cascade_closure(e: DataFrame, p: DataFrame) -> DataFrame:
    """All findings that rest on a fallen one, over any number of edges: a semi-naive loop that ends with the new rows.

    Each round is checkpointed in the folder that spark.checkpoint.dir names, where there is one, so plans stay short.
    """
    kept = (lambda df: df.checkpoint()) if p.sparkSession.conf.get("spark.checkpoint.dir", None) else (lambda df: df)
    step = e.filter(F.col("type").isin(*DEPENDENT)).select("src", "dst").distinct()
    reached = p.filter(F.col("status").isin(*FALLEN)).select("id").distinct()
    start, new = reached, reached
    while True:
        new = step.join(new.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")).distinct().join(reached, "id", "left_anti")
        new = kept(new)
        if new.isEmpty():
            return reached.join(start, "id", "left_anti")
        reached = kept(reached.union(new))


def stale(p: DataFrame, data_version: str, commits: DataFrame) -> DataFrame:
    """Findings whose data version, or whose script's commit, is not the current one (commits: script, commit)."""
    now = commits.select("script", F.col("commit").alias("now"))
    old_data = F.col("data_version").isNotNull() & (F.col("data_version") != data_version)
    return p.join(now, "script", "left").filter(old_data | (F.col("now").isNotNull() & (F.col("commit") != F.col("now")))).select("id", "data_version", "commit", "now")


def broken_links(p: DataFrame, all_paths: DataFrame) -> DataFrame:
    """Links of a body to finding files that do not exist."""
    target = p.select("id", F.explode("links").alias("k")).select("id", F.element_at(F.split(F.regexp_replace("k.target", r"[#?].*$", ""), "/"), -1).alias("file")).filter(F.col("file").rlike(r"^[0-9]{4}-.*\.md$"))
    files = all_paths.select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return target.join(files, "file", "left_anti").distinct()


def manifest(p: DataFrame) -> DataFrame:
    return p.filter("id is not null").select("id", "title", "status", "phase", F.coalesce("kind", F.lit("discovery")).alias("kind"), "summary", "path").orderBy("id")


def next_id(p: DataFrame) -> DataFrame:
    return p.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def dashboard(p: DataFrame) -> DataFrame:
    """Counts by status, phase and kind, each alone and all together."""
    base = p.select("status", "phase", F.coalesce("kind", F.lit("discovery")).alias("kind"))
    return base.groupingSets([["status"], ["phase"], ["kind"], []], "status", "phase", "kind").agg(F.count("*").alias("n"))


def by_entity(entities: DataFrame) -> DataFrame:
    """entities(id, entity): how many findings name each."""
    return entities.distinct().groupBy("entity").agg(F.count("*").alias("n_findings"), F.array_sort(F.collect_list("id")).alias("ids"))


def most_connected(e: DataFrame, top: int = 10) -> DataFrame:
    ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(top)


def contradicting(e: DataFrame) -> DataFrame:
    return e.filter("type = 'contradicts'").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def overlap(entities: DataFrame) -> DataFrame:
    """Pairs of findings and the number of entities they share."""
    e = entities.distinct()
    a, b = e.select("entity", F.col("id").alias("a")), e.select("entity", F.col("id").alias("b"))
    return a.join(b, "entity").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def transitions(changes: DataFrame) -> DataFrame:
    """changes(id, old, new, signoff, reproduced, replicated, phase, data_replicated) with `allowed`."""
    bar = F.col("signoff") & F.col("reproduced") & F.col("replicated") & ((F.col("phase") != "confirmatory") | F.col("data_replicated"))
    forward = ((F.col("old") == "candidate") & (F.col("new") == "under_exploration")) | ((F.col("old") == "under_exploration") & (F.col("new") == "validated") & bar)
    return changes.withColumn("allowed", F.coalesce(F.col("old").isin(*STATES) & F.col("new").isin(*STATES) & (forward | F.col("new").isin("invalidated", "superseded", "closed")), F.lit(False)))


def registry(results: DataFrame, referenced: DataFrame) -> DataFrame:
    """results(analysis, outcome, fingerprint, created): current, superseded or protected (an older one that is cited)."""
    w = Window.partitionBy("analysis", "outcome").orderBy(F.desc("created"), "fingerprint")
    cited = referenced.select("fingerprint").distinct().withColumn("_c", F.lit(True))
    ranked = results.withColumn("_n", F.row_number().over(w)).join(cited, "fingerprint", "left")
    return ranked.withColumn("status", F.when(F.col("_n") == 1, "current").when(F.col("_c"), "protected").otherwise("superseded")).drop("_n", "_c")


def blinded(p: DataFrame) -> DataFrame:
    """What a blind verifier may see: the question without verdict, summary, evidence, figures and body."""
    return p.select("id", "title", "phase", "kind", "script", "data_version")


def reportable(p: DataFrame, e: DataFrame, mode: str = "research") -> DataFrame:
    """Findings for a report (research: validated ones; qc: all) with the caveats they relate to."""
    chosen = p.filter("status = 'validated'") if mode == "research" else p
    caveat = p.filter("kind = 'caveat'").select(F.col("id").alias("dst"), F.col("title").alias("caveat"))
    notes = e.filter("type = 'relates_to'").join(caveat, "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("caveat")).alias("caveats"))
    return chosen.select("id", "title", "status", "summary").join(notes, "id", "left")


def under_data(path: Column, cwd: str = "/project") -> Column:
    """Whether a written path, resolved by its text alone, is data/ or below it."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(cwd + "/"), path))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    solid = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))
    joined = F.concat(F.lit("/"), F.array_join(solid, "/"))
    return (joined == f"{cwd}/data") | joined.startswith(f"{cwd}/data/")


def writes_data(command: Column) -> Column:
    """Whether a shell command redirects into, or edits, something below data/ (best effort)."""
    target = r"[.]?/?data/"
    return command.rlike(rf"(?:>{{1,2}}|tee\s+(?:-a\s+)?)\s*{target}") | command.rlike(rf"(?:\b(?:rm|mv|cp|truncate|dd)\b|sed\s+-i)[^|]*\s{target}")


def state(raw: Column) -> Column:
    """Workflow state from JSON text: gate and layout flags; malformed text counts as a closed gate without layout rules."""
    s = F.from_json(raw, "integrity_gate struct<passed:boolean>, figures_layout string")
    return F.struct(F.coalesce(s["integrity_gate"]["passed"], F.lit(False)).alias("gate_passed"), F.coalesce(s["figures_layout"] == "structured", F.lit(False)).alias("structured"))
