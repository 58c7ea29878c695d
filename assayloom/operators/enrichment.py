"""Over-representation: accessions, mapping audit, offline hypergeometric test, and the service response as a table."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dataset import Refusal
from ..functions.columns import benjamini_hochberg
from ..functions.special import hypergeometric_sf

# Fixed value: the form of a UniProt accession.
ACCESSION = r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})$"
SOURCES = ("GO:BP", "GO:MF", "GO:CC", "KEGG", "REAC", "WP")


class EnrichmentMappingWarning(UserWarning):
    pass


class EnrichmentServiceError(RuntimeError):
    pass


def accession(raw: Column) -> Column:
    """First UniProt accession of an identifier or group of them, isoform suffix gone; null if there is none."""
    tokens = F.transform(F.split(raw, r"[;,\s|]+"), lambda t: F.regexp_replace(F.trim(t), r"-\d+$", ""))
    return F.get(F.filter(tokens, lambda t: t.rlike(ACCESSION)), F.lit(0))


def source_class(raw: Column, found: Column) -> Column:
    return F.when(found.isNull(), "unmappable").when(F.lower(raw).startswith("sp|"), "swissprot").when(F.lower(raw).startswith("tr|"), "trembl").otherwise("other")


def mapping_audit(query: DataFrame, background: DataFrame, id_parser: Callable[[Column], Column] = accession) -> DataFrame:
    """One row per distinct id (column `id`) of either list."""
    q, b = query.select("id").distinct().withColumn("q", F.lit(True)), background.select("id").distinct().withColumn("b", F.lit(True))
    found = id_parser(F.col("id"))
    out = q.join(b, "id", "full_outer")
    return out.select(F.col("id").alias("original_id"), found.alias("uniprot_accession"), source_class(F.col("id"), found).alias("source"), F.coalesce("q", F.lit(False)).alias("in_query"), F.coalesce("b", F.lit(False)).alias("in_background"))


def checked(audit: DataFrame, min_mapping_rate: float = 0.5) -> None:
    outside = audit.filter("in_query and not in_background").count()
    if outside:
        raise Refusal(f"{outside} query identifiers are not in the background")
    rates = audit.filter("in_query").agg(F.count("uniprot_accession"), F.count("*")).first()
    if not rates[0]:
        raise Refusal("no query identifier maps to an accession")
    if rates[0] < min_mapping_rate * rates[1]:
        warnings.warn(f"only {rates[0]} of {rates[1]} query identifiers map", EnrichmentMappingWarning, stacklevel=2)


def over_representation(query: DataFrame, background: DataFrame, terms: DataFrame, correction: str = "fdr", threshold: float = 0.05) -> DataFrame:
    """Hypergeometric test of every term (terms: source, term, gene) in a query against a background (column gene).

    Counts are two semi-joins and one aggregate; only (k, N, K, n), a row a term, reaches the tail function.
    """
    if correction not in ("fdr", "bonferroni"):
        raise Refusal(f"unknown correction {correction!r}")
    b, q = background.select("gene").distinct(), query.select("gene").distinct()
    if q.join(b, "gene", "left_anti").limit(1).count():
        raise Refusal("the query is not part of the background")
    domain, size = b.count(), q.count()
    known = terms.select("source", "term", "gene").distinct().join(b, "gene", "left_semi")
    marked = known.join(q.withColumn("_q", F.lit(1)), "gene", "left")
    per = marked.groupBy("source", "term").agg(F.count("*").alias("term_size"), F.count("_q").alias("intersection_size"), F.array_sort(F.collect_list(F.when(F.col("_q") == 1, F.col("gene")))).alias("genes"))
    per = per.filter("intersection_size > 0")

    @F.pandas_udf("double")
    def tail(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k, m in batches:
            yield pd.Series([hypergeometric_sf(int(a), domain, int(c), size) for a, c in zip(k, m)])

    out = per.withColumn("p_raw", tail("intersection_size", "term_size"))
    out = benjamini_hochberg(out, "p_raw", out="p_value") if correction == "fdr" else out.withColumn("p_value", F.least(F.lit(1.0), F.col("p_raw") * F.count("*").over(Window.partitionBy())))
    return out.select(
        "source", "term", "p_raw", "p_value", (F.col("p_value") <= threshold).alias("significant"), "term_size", F.lit(size).alias("query_size"), "intersection_size", F.lit(domain).alias("effective_domain_size"),
        (F.col("intersection_size") / size).alias("gene_ratio"), (F.col("intersection_size") / F.col("term_size")).alias("recall"), F.array_join("genes", ";").alias("intersecting_genes"),
    )


def query_of(table: DataFrame, direction: str = "both", fdr: float = 0.05, effect_threshold: float = 0.0) -> DataFrame:
    """Features of a differential table that make the query: up, down or both."""
    hit = F.col("q") <= fdr
    side = {"up": F.col("effect") >= effect_threshold, "down": F.col("effect") <= -effect_threshold, "both": F.abs("effect") >= effect_threshold}[direction]
    return table.filter(hit & side & (F.col("effect") != 0)).select(F.col("feature").alias("id"))


def ask(transport: Callable[[str, dict, float], str], url: str, payload: dict, timeout: float = 120) -> str:
    """One request on the driver through an injected transport; there is none by default, as nothing goes out unasked."""
    try:
        return transport(url, payload, timeout)
    except Exception as e:
        raise EnrichmentServiceError(str(e)) from e


RESPONSE = "result array<struct<source:string,native:string,name:string,p_value:double,significant:boolean,term_size:long,query_size:long,intersection_size:long,effective_domain_size:long,intersections:array<array<string>>>>, meta struct<version:string>"


def response_table(spark: SparkSession, body: str, genes: list[str]) -> DataFrame:
    """A service's JSON as a table: members are the query genes with evidence; a list of another length gives none."""
    meta = json.loads(body).get("meta", {})
    if not meta.get("version"):
        warnings.warn("the response names no version", EnrichmentMappingWarning, stacklevel=2)
    r = spark.createDataFrame([(body, genes)], "body string, genes array<string>").withColumn("r", F.from_json("body", RESPONSE)).select("genes", F.explode("r.result").alias("t"))
    pairs = F.arrays_zip(F.col("genes").alias("g"), F.col("t.intersections").alias("i"))
    members = F.when(F.size("t.intersections") == F.size("genes"), F.array_join(F.transform(F.filter(pairs, lambda x: F.size(x["i"]) > 0), lambda x: x["g"]), ";")).otherwise("")
    place = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    out = r.select("t.source", F.col("t.native").alias("term"), "t.name", "t.p_value", "t.significant", "t.term_size", "t.query_size", "t.intersection_size", "t.effective_domain_size", F.expr("try_divide(t.intersection_size, t.query_size)").alias("gene_ratio"), F.expr("try_divide(t.intersection_size, t.term_size)").alias("recall"), members.alias("intersecting_genes"))
    return out.orderBy(F.when(place > 0, place).otherwise(len(SOURCES) + 1), "p_value", "term")


@dataclass(frozen=True)
class Enrichment:
    """table (terms, members as genes), audit (one row per identifier), callers (gene, id: the first identifier that gave it),
    and what the service, or the given terms, recognized of the query."""

    table: DataFrame
    audit: DataFrame
    callers: DataFrame
    recognized: int
    asked: int
    version: str | None


def callers(ids: DataFrame, id_parser: Callable[[Column], Column] = accession) -> DataFrame:
    """gene and the identifier it came from; of several the first by `ord` (by itself without one)."""
    rank = F.struct("ord", "id") if "ord" in ids.columns else F.struct("id")
    return ids.withColumn("gene", id_parser(F.col("id"))).filter("gene is not null").groupBy("gene").agg(F.min_by("id", rank).alias("id"))


def enrich(
    query: DataFrame, background: DataFrame, *, terms: DataFrame | None = None, transport: Callable[[str, dict, float], str] | None = None, url: str = "", organism: str = "", sources: tuple[str, ...] = SOURCES,
    id_parser: Callable[[Column], Column] = accession, correction: str | None = None, threshold: float = 0.05, all_results: bool = True, min_mapping_rate: float = 0.5, timeout: float = 120,
) -> Enrichment:
    """Over-represented terms of a query (column `id`) against a background, from given terms or through a transport.

    Both lists are audited first; members of terms come back as the caller's identifiers. Given terms (source, term, gene) are
    tested here, by fdr or bonferroni; a service corrects by itself (g_SCS unless another is named). The one of the two
    that is wanted must be given, and no other.
    """
    if (terms is None) == (transport is None):
        raise Refusal("either terms or a transport is needed")
    correction = correction or ("g_SCS" if terms is None else "fdr")
    if correction not in (("g_SCS", "fdr", "bonferroni") if terms is None else ("fdr", "bonferroni")):
        raise Refusal(f"{correction!r} cannot be had this way")
    audit = mapping_audit(query, background, id_parser)
    checked(audit, min_mapping_rate)
    mine, all_ = callers(query, id_parser), callers(background, id_parser)
    spark = query.sparkSession
    if terms is not None:
        known = terms.filter(F.col("source").isin(*sources)) if sources else terms
        table, version = over_representation(mine.select("gene"), all_.select("gene"), known, correction, threshold), None
        recognized, asked = mine.join(known.select("gene").distinct(), "gene", "left_semi").count(), mine.count()
    else:
        genes = [r["gene"] for r in mine.orderBy("gene").collect()]  # a query of a study: it goes into one request
        payload = {"organism": organism, "query": genes, "background": [r["gene"] for r in all_.orderBy("gene").collect()], "sources": list(sources), "user_threshold": threshold, "all_results": all_results, "significance_threshold_method": correction, "domain_scope": "custom", "no_evidences": False}
        body = ask(transport, url, payload, timeout)
        table, meta = response_table(spark, body, genes), json.loads(body).get("meta", {})
        failed = {str(g) for g in meta.get("genes_metadata", {}).get("failed", [])}
        version, recognized, asked = meta.get("version"), len([g for g in genes if g not in failed]), len(genes)
    if not all_results:
        table = table.filter("significant")
    named = table.withColumn("gene", F.explode_outer(F.split("intersecting_genes", ";"))).join(mine.withColumnRenamed("id", "_caller"), "gene", "left")
    ids = named.groupBy("source", "term").agg(F.array_join(F.array_sort(F.collect_set("_caller")), ";").alias("intersecting_ids"))
    return Enrichment(table.join(ids, ["source", "term"], "left"), audit, mine, recognized, asked, version)


def manhattan(table: DataFrame, gap: int = 10) -> DataFrame:
    """x of each term: its place by id within its source, after the sources before it and a gap each."""
    placed = table.withColumn("_i", F.row_number().over(Window.partitionBy("source").orderBy("term")))
    sizes = table.groupBy("source").agg(F.count("*").alias("_n")).withColumn("_at", F.coalesce(F.sum(F.col("_n") + gap).over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(sizes), "source").withColumn("x", F.col("_at") + F.col("_i")).withColumn("size", 30 + 22 * F.pow("intersection_size", F.lit(0.6))).drop("_i", "_n", "_at")


def top_terms(table: DataFrame, per_source: int = 10) -> DataFrame:
    w = Window.partitionBy("source").orderBy("p_value", "term")
    return table.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_source).drop("_n")


def assigned_colors(values: DataFrame, known: DataFrame, palette: list[str]) -> DataFrame:
    """values(value, ord) with a colour each: known ones (value, hex) keep theirs, new ones take unused ones in order."""
    used = {r[0] for r in known.select("hex").collect()}
    free = [c for c in palette if c not in used]
    new = values.groupBy("value").agg(F.min("ord").alias("ord")).join(known, "value", "left_anti")
    if new.count() > len(free):
        raise Refusal("more values than colours left")
    if not free:
        return known.select("value", "hex")
    at = F.row_number().over(Window.orderBy("ord", "value"))
    return known.select("value", "hex").unionByName(new.select("value", F.element_at(F.array(*[F.lit(c) for c in free]), at).alias("hex")))

