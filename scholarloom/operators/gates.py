"""Checks over stored structured outputs: schema, quality, citations, publication, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarloom import settings
from scholarloom.functions.text import comparison_form, label_form

CLAIM = "struct<text:string,type:string,evidence_ids:array<string>>"
BRIEF_SCHEMA = (
    "schema_version string, work_id string, change string, problem string, contribution string, evidence_state string, "
    "limitations array<string>, code_state string, technical_relevance string, commercial_relevance string, "
    f"recommended_action string, claims array<{CLAIM}>, _corrupt string"
)
SECTION = "struct<markdown:string,confidence:double,claim_ids:array<string>>"
SECTIONS = ["executive_significance", "problem_context", "method", "evaluation", "limitations"]
DEEP_CLAIM = (
    "struct<id:string,text:string,type:string,importance:string,verification_status:string,"
    "evidence_ids:array<string>,qualifier:string>"
)
DEEP_SCHEMA = (
    "schema_version string, work_id string, title string, publication_status string, "
    + ", ".join(f"{s} {SECTION}" for s in SECTIONS)
    + ", reproducibility struct<status:string,repository_urls:array<string>,assets:array<string>,hardware_fit:string,"
    "steps:array<string>,risks:array<string>>, "
    "production_applications array<struct<name:string,system_change:string,expected_value:string,risks:array<string>,claim_ids:array<string>>>, "
    "commercial_hypotheses array<struct<problem:string,buyer:string,workflow:string,pilot:string,value_metric:string,"
    "confidence:double,evidence_ids:array<string>,unknowns:array<string>>>, "
    "learning_path array<struct<concept:string,reason:string,sequence:int,source_ids:array<string>>>, "
    "skeptic_findings array<struct<severity:string,finding:string,affected_claim_ids:array<string>,resolution:string>>, "
    f"claims array<{DEEP_CLAIM}>, _corrupt string"
)
BRIEF_FIELDS = [f.split()[0] for f in BRIEF_SCHEMA.split(", ") if not f.startswith("_")]
DEEP_FIELDS = (
    ["schema_version", "work_id", "title", "publication_status", *SECTIONS, "reproducibility", "production_applications",
     "commercial_hypotheses", "learning_path", "skeptic_findings", "claims"])
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
NARRATIVE = ["change", "problem", "contribution", "technical_relevance", "commercial_relevance"]


def _reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that do not hold; a NULL counts as not holding."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    return F.filter(F.array(*broken), lambda r: r.isNotNull())


def _length(text: Column, low: int, high: int | None = None) -> Column:
    size = F.length(text)
    return size >= low if high is None else size.between(low, high)


def _relabel(items: Column, names: list[str], labelled: dict[str, list[str]]) -> Column:
    """Structs of ``items`` with their label fields brought to the allowed options."""
    return F.transform(items, lambda x: F.struct(*[
        (label_form(x[n], labelled[n]) if n in labelled else x[n]).alias(n) for n in names]))


KINDS = {"string": ["STRING"], "double": ["DOUBLE", "FLOAT", "DECIMAL", "BIGINT"], "int": ["BIGINT"]}


def _shape(value: Column, kind: T.DataType) -> tuple[Column, Column]:
    """Whether ``value`` (variant) has no field beyond ``kind`` at any depth, and whether its scalars and nestings are of this kind.

    Missing values and NULLs pass; the rules of a field say whether it may be empty.
    """
    found = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    empty = value.isNull() | (found == "VOID")
    yes = F.lit(True)
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        known = F.coalesce(F.forall(items, lambda x: _shape(x, kind.elementType)[0]), yes)
        return known, empty | ((found == "ARRAY") & F.coalesce(F.forall(items, lambda x: _shape(x, kind.elementType)[1]), yes))
    if isinstance(kind, T.StructType):
        # The object is read once and named by the lambda.
        fields = F.array(F.try_variant_get(value, "$", "map<string,variant>"))
        names = F.array(*[F.lit(f.name) for f in kind])

        def known_in(m: Column) -> Column:
            ok = F.coalesce(F.size(F.array_except(F.map_keys(m), names)) == 0, yes)
            for f in kind:
                if isinstance(f.dataType, (T.ArrayType, T.StructType)):
                    ok &= _shape(m[f.name], f.dataType)[0]
            return ok

        def fits_in(m: Column) -> Column:
            ok = yes
            for f in kind:
                ok &= _shape(m[f.name], f.dataType)[1]
            return ok

        return F.forall(fields, known_in), empty | ((found == "OBJECT") & F.forall(fields, fits_in))
    return yes, empty | found.isin(KINDS[kind.simpleString()])


def _nested_rules(text: str, schema: str) -> list[tuple[str, Column]]:
    """Rules about fields inside the fields, and about kinds; unknown fields of the top level have their own rule."""
    root = F.array(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"))
    fields = [f for f in T.DataType.fromDDL(schema) if not f.name.startswith("_")]

    def every(m: Column, part: int) -> Column:
        ok = F.lit(True)
        for f in fields:
            ok &= _shape(m[f.name], f.dataType)[part]
        return ok

    return [("nested unknown field", F.forall(root, lambda m: every(m, 0))), ("field kind", F.forall(root, lambda m: every(m, 1)))]


def _filled(items: Column) -> Column:
    """A list without NULLs."""
    return F.forall(items, lambda x: x.isNotNull())


def read_briefs(outputs: DataFrame, text: str = "output_json") -> DataFrame:
    """``brief`` and ``reasons`` (empty when valid) of each stored brief, labels brought to form first."""
    read = outputs.withColumn("_b", F.from_json(text, BRIEF_SCHEMA, OPTIONS))
    labels = settings.LABELS
    fixed = {n: label_form(F.col(f"_b.{n}"), labels[n]) for n in ("evidence_state", "code_state", "recommended_action")}
    fixed["claims"] = _relabel(F.col("_b.claims"), ["text", "type", "evidence_ids"], {"type": labels["claim_type"]})
    read = read.withColumn("brief", F.struct(*[fixed.get(n, F.col(f"_b.{n}")).alias(n) for n in BRIEF_FIELDS]))
    b = F.col("brief")
    unknown = F.array_except(F.json_object_keys(text), F.array(*[F.lit(n) for n in [*BRIEF_FIELDS, "_verification"]]))
    rules = [
        ("not a JSON object", F.col("_b._corrupt").isNull() & F.json_object_keys(text).isNotNull()),
        ("unknown field", F.size(unknown) == 0),
        ("schema_version", b["schema_version"] == "1.0"),
        ("work_id", _length(b["work_id"], 1)),
        ("change", _length(b["change"], 1, 320)),
        *[(n, _length(b[n], 8, 800)) for n in NARRATIVE[1:]],
        *[(n, b[n].isin(labels[n])) for n in ("evidence_state", "code_state", "recommended_action")],
        ("limitations", F.size(b["limitations"]).between(1, 8) & _filled(b["limitations"])),
        ("claims", F.size(b["claims"]).between(1, 20)),
        ("claim text", F.forall(b["claims"], lambda c: _length(c["text"], 1, 1000))),
        ("claim type", F.forall(b["claims"], lambda c: c["type"].isin(labels["claim_type"]))),
        ("claim evidence", F.forall(b["claims"], lambda c: F.size(c["evidence_ids"]).between(0, 12) & _filled(c["evidence_ids"]))),
        *_nested_rules(text, BRIEF_SCHEMA),
    ]
    return read.withColumn("reasons", _reasons(rules)).drop("_b")


def read_deep_reports(outputs: DataFrame, text: str = "output_json") -> DataFrame:
    """``report`` and ``reasons`` (empty when valid) of each stored deep report."""
    read = outputs.withColumn("_d", F.from_json(text, DEEP_SCHEMA, OPTIONS))
    labels = settings.LABELS
    d = F.col("_d")
    repro = d["reproducibility"]
    fixed = {
        "publication_status": label_form(d["publication_status"], labels["publication_status"]),
        "reproducibility": F.when(repro.isNotNull(), F.struct(
            label_form(repro["status"], labels["reproducibility"]).alias("status"), repro["repository_urls"].alias("repository_urls"),
            repro["assets"].alias("assets"), label_form(repro["hardware_fit"], labels["hardware_fit"]).alias("hardware_fit"),
            repro["steps"].alias("steps"), repro["risks"].alias("risks"))),
        "skeptic_findings": _relabel(
            d["skeptic_findings"], ["severity", "finding", "affected_claim_ids", "resolution"],
            {"severity": labels["severity"], "resolution": labels["resolution"]}),
        "claims": _relabel(
            d["claims"], ["id", "text", "type", "importance", "verification_status", "evidence_ids", "qualifier"],
            {"type": labels["claim_type"], "importance": labels["importance"], "verification_status": labels["verification_status"]}),
    }
    read = read.withColumn("report", F.struct(*[fixed.get(n, d[n]).alias(n) for n in DEEP_FIELDS]))
    r = F.col("report")

    def share(value: Column) -> Column:
        return value.between(0, 1)

    unknown = F.array_except(F.json_object_keys(text), F.array(*[F.lit(n) for n in [*DEEP_FIELDS, "_verification"]]))
    rules = [
        ("not a JSON object", d["_corrupt"].isNull() & F.json_object_keys(text).isNotNull()),
        ("unknown field", F.size(unknown) == 0),
        ("schema_version", r["schema_version"] == "1.0"),
        ("work_id", _length(r["work_id"], 1)),
        ("title", _length(r["title"], 1)),
        ("publication_status", r["publication_status"].isin(labels["publication_status"])),
        *[(s, _length(r[s]["markdown"], 8) & share(r[s]["confidence"]) & _filled(r[s]["claim_ids"])) for s in SECTIONS],
        ("reproducibility", r["reproducibility"]["status"].isin(labels["reproducibility"])
         & r["reproducibility"]["hardware_fit"].isin(labels["hardware_fit"])
         & F.forall(r["reproducibility"]["repository_urls"], lambda u: u.rlike("^https?://"))
         & _filled(r["reproducibility"]["assets"]) & _filled(r["reproducibility"]["steps"]) & _filled(r["reproducibility"]["risks"])),
        ("production_applications", F.forall(r["production_applications"], lambda a: a["name"].isNotNull()
         & a["system_change"].isNotNull() & a["expected_value"].isNotNull() & _filled(a["risks"]) & _filled(a["claim_ids"]))),
        ("commercial_hypotheses", F.forall(r["commercial_hypotheses"], lambda h: h["problem"].isNotNull() & h["buyer"].isNotNull()
         & h["workflow"].isNotNull() & h["pilot"].isNotNull() & h["value_metric"].isNotNull() & share(h["confidence"])
         & _filled(h["evidence_ids"]) & _filled(h["unknowns"]))),
        ("learning_path", F.forall(r["learning_path"], lambda s: s["concept"].isNotNull() & s["reason"].isNotNull() & (s["sequence"] >= 1))),
        ("skeptic_findings", F.forall(r["skeptic_findings"], lambda f: f["severity"].isin(labels["severity"])
         & f["resolution"].isin(labels["resolution"]) & f["finding"].isNotNull() & _filled(f["affected_claim_ids"]))),
        ("claims", F.size(r["claims"]) >= 1),
        ("claim fields", F.forall(r["claims"], lambda c: _length(c["id"], 1) & _length(c["text"], 1) & _filled(c["evidence_ids"]))),
        ("claim labels", F.forall(r["claims"], lambda c: c["type"].isin(labels["claim_type"])
         & c["importance"].isin(labels["importance"]) & c["verification_status"].isin(labels["verification_status"]))),
        *_nested_rules(text, DEEP_SCHEMA),
    ]
    return read.withColumn("reasons", _reasons(rules)).drop("_d")


def _all_distinct(items: Column) -> Column:
    return F.size(F.array_distinct(items)) == F.size(items)


def brief_quality(briefs: DataFrame) -> DataFrame:
    """Adds ``quality_error`` to (brief, title): empty or repeated narrative, title echo, repeated items."""
    b = F.col("brief")
    values = F.array(*[comparison_form(b[n]) for n in NARRATIVE])
    limitations = F.transform(b["limitations"], comparison_form)
    claims = F.transform(b["claims"], lambda c: comparison_form(c["text"]))
    return briefs.withColumn("quality_error", (
        F.when(F.array_contains(values, "") | ~_all_distinct(values), "NARRATIVE_NOT_DISTINCT")
        .when(F.array_contains(values, comparison_form(F.col("title"))), "NARRATIVE_IS_TITLE")
        .when(~_all_distinct(limitations), "LIMITATIONS_NOT_DISTINCT")
        .when(~_all_distinct(claims), "CLAIMS_NOT_DISTINCT")))


def deep_quality(reports: DataFrame) -> DataFrame:
    """Adds ``quality_error``: the five sections must differ."""
    sections = F.array(*[comparison_form(F.col("report")[s]["markdown"]) for s in SECTIONS])
    return reports.withColumn("quality_error", F.when(~_all_distinct(sections), "SECTIONS_NOT_DISTINCT"))


def claim_rows(outputs: DataFrame, column: str) -> DataFrame:
    """One row per claim of (run_id, ``brief`` or ``report``): claim_no, claim_id and its fields."""
    exploded = outputs.select("run_id", F.posexplode(F.col(column)["claims"]).alias("at", "c"))
    own = F.concat_ws("-claim-", F.col("run_id").cast("string"), (F.col("at") + 1).cast("string"))
    if column == "brief":
        supported = F.when(F.size("c.evidence_ids") > 0, "supported").otherwise("unsupported")
        extra = [F.lit("major").alias("importance"), supported.alias("verification_status"), F.lit(None).cast("string").alias("local_id")]
    else:
        extra = ["c.importance", "c.verification_status", F.col("c.id").alias("local_id")]
    return exploded.select("run_id", (F.col("at") + 1).alias("claim_no"), own.alias("claim_id"),
                           F.col("c.text").alias("claim_text"), F.col("c.type").alias("claim_type"), *extra, "c.evidence_ids")


def claim_evidence(claims: DataFrame, allowed: DataFrame) -> DataFrame:
    """Provenance edges: distinct citations that are in the allowed set of the run, weight 1."""
    cited = claims.select("run_id", "claim_id", F.explode("evidence_ids").alias("span_id")).distinct()
    return cited.join(allowed.select("run_id", "span_id").distinct(), ["run_id", "span_id"], "left_semi").select(
        "claim_id", "span_id", F.lit("supports").alias("relation"), F.lit(1.0).alias("relevance"))


def section_rows(outputs: DataFrame, column: str) -> DataFrame:
    """The stored section of each validated output."""
    brief = column == "brief"
    text = F.col(column)["change"] if brief else F.col(column)["executive_significance"]["markdown"]
    return outputs.select("run_id", F.lit("brief" if brief else "report").alias("section_key"), F.lit(1).alias("section_order"),
                          F.lit("verified").alias("status"), text.alias("content_markdown"), F.lit(1.0).alias("confidence"))


def verify_citations(
    runs: DataFrame, claims: DataFrame, allowed: DataFrame, *, deep: bool = False,
    section_refs: DataFrame | None = None, threshold: float = settings.COVERAGE_THRESHOLD,
) -> DataFrame:
    """(run_id, citation_coverage, citations_verified, reason); reason NULL when the output passes.

    ``runs``: run_id, identity_matches, metadata_matches. ``claims``: claim_rows. ``allowed``:
    run_id, span_id. The first failing claim decides the reason, as does the first failing check in it.
    """
    factual = F.col("claim_type").isin(settings.FACTUAL_TYPES)
    needed = factual & F.col("importance").isin("major", "critical") if deep else factual
    cited = claims.select("run_id", "claim_no", F.explode("evidence_ids").alias("span_id")).distinct()
    known = allowed.select("run_id", "span_id").distinct().withColumn("_known", F.lit(True))
    per_claim = cited.join(known, ["run_id", "span_id"], "left").groupBy("run_id", "claim_no").agg(
        F.count("*").alias("n"), F.count_if(F.col("_known").isNull()).alias("foreign"))
    checked = claims.join(per_claim, ["run_id", "claim_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    failure = F.when(F.col("foreign") > 0, F.struct("claim_no", F.lit(1).alias("c"), F.lit("FOREIGN_EVIDENCE").alias("r")))
    failure = failure.when(factual & (F.col("n") == 0), F.struct("claim_no", F.lit(2).alias("c"), F.lit("UNCITED_CLAIM").alias("r")))
    if deep:
        failure = failure.when(factual & (F.col("verification_status") == "unsupported"), F.struct(
            "claim_no", F.lit(3).alias("c"), F.lit("UNREFUSED_CLAIM").alias("r")))
    per_run = checked.groupBy("run_id").agg(
        F.min(failure).alias("_failure"), F.count_if(needed).alias("_required"),
        F.count_if(needed & (F.col("n") > 0)).alias("_supported"), F.sum("n").alias("citations_verified"))
    joined = runs.join(per_run, "run_id", "left")
    if section_refs is not None:
        own = claims.select("run_id", F.col("local_id").alias("claim_ref")).distinct()
        dangling = section_refs.join(own, ["run_id", "claim_ref"], "left_anti").select("run_id").distinct().withColumn("_dangling", F.lit(True))
        joined = joined.join(dangling, "run_id", "left")
    else:
        joined = joined.withColumn("_dangling", F.lit(None).cast("boolean"))
    required = F.coalesce("_required", F.lit(0))
    coverage = F.when(required == 0, 1.0).otherwise(F.col("_supported") / F.col("_required"))
    reason = (
        F.when(~F.col("identity_matches"), "IDENTITY_MISMATCH")
        .when(~F.col("metadata_matches"), "METADATA_MISMATCH")
        .when(F.col("_dangling"), "DANGLING_CLAIM_REFERENCE")
        .when(F.col("_failure").isNotNull(), F.col("_failure.r"))
        .when(coverage < threshold, "COVERAGE_BELOW_THRESHOLD"))
    return joined.select("run_id", coverage.alias("citation_coverage"),
                         F.coalesce("citations_verified", F.lit(0)).alias("citations_verified"), reason.alias("reason"))


def report_section_refs(reports: DataFrame) -> DataFrame:
    """(run_id, claim_ref): claim ids the sections of a deep report refer to."""
    refs = F.flatten(F.array(*[F.col("report")[s]["claim_ids"] for s in SECTIONS]))
    return reports.select("run_id", F.explode(F.array_distinct(refs)).alias("claim_ref"))


def publication_gate(reports: DataFrame) -> DataFrame:
    """(run_id, decision, error_code) of deep reports: open critical findings first, then unsupported facts."""
    r = F.col("report")
    critical = F.exists(r["skeptic_findings"], lambda f: (f["severity"] == "critical") & f["resolution"].isin("rejected", "unresolved"))
    unsupported = F.exists(r["claims"], lambda c: c["type"].isin(settings.FACTUAL_TYPES) & (
        (c["verification_status"] != "supported") | (F.size(c["evidence_ids"]) == 0)))
    code = F.when(critical, "CRITICAL_SKEPTIC_FINDING").when(unsupported, "UNSUPPORTED_CLAIMS")
    return reports.select("run_id", F.when(code.isNull(), "published").otherwise("rejected").alias("decision"), code.alias("error_code"))


def unsupported_claims(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Factual claims without any evidence edge."""
    return claims.filter(F.col("claim_type").isin(settings.FACTUAL_TYPES)).join(edges.select("claim_id"), "claim_id", "left_anti")


def cited_evidence(edges: DataFrame) -> DataFrame:
    return edges.select("span_id").distinct()


def split_cached(requests: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests answered by a stored run, requests still to do), by the four-part cache key."""
    key = ["analysis_type", "input_fingerprint", "model_profile", "prompt_version"]
    return requests.join(stored.select(*key), key, "left_semi"), requests.join(stored.select(*key), key, "left_anti")


def outdated_outputs(validated: DataFrame) -> DataFrame:
    """Stored outputs that no longer pass the schema, marked as rejected."""
    bad = F.size("reasons") > 0
    return validated.withColumn("shown_status", F.when(bad, "rejected").otherwise(F.col("status"))).withColumn(
        "shown_error", F.when(bad, "STORED_OUTPUT_OUTDATED"))
