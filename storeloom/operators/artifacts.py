"""Context selection: which captured pieces of a page a question needs, and why.

Artifacts: (page_id, pos, id, artifact_kind, raw_markdown). Classifications: (page_id, pos, id,
roles array, reason). Headers: (page_id, provider_name, selection_mode, provider_reason), no row where
nothing classified the page. All steps are joins and aggregates by page.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeloom.functions.text import utf16_length

# The base roles and which of them are noise.
BASE_ROLES = ("html", "product-description", "certificate", "related-product", "promo", "ui", "unknown")
BASE_NOISE = ("ui", "promo", "related-product")


class VocabularyError(ValueError):
    pass


@dataclass(frozen=True)
class Vocabulary:
    roles: tuple[str, ...] = BASE_ROLES
    preferences: dict[str, tuple[str, ...]] = field(default_factory=dict)
    structural: str = "html"
    unknown: str = "unknown"
    noise: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.noise is None:
            object.__setattr__(self, "noise", tuple(r for r in self.roles if r in BASE_NOISE))
        named = {"structural": (self.structural,), "unknown": (self.unknown,), "noise": self.noise} | {f"preferences of {k}": v for k, v in self.preferences.items()}
        for label, roles in named.items():
            if absent := [r for r in roles if r not in self.roles]:
                raise VocabularyError(f"{label}: not among the roles: {', '.join(absent)}")


def words(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def default_roles(kind: Column, v: Vocabulary) -> Column:
    return F.array(F.when(kind == "html", v.structural).otherwise(v.unknown))


def default_classification(artifacts: DataFrame, v: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Headers and classifications of the provider that knows kinds only."""
    heads = artifacts.select("page_id").distinct().select("page_id", F.lit("default").alias("provider_name"), F.lit("full").alias("selection_mode"), F.lit("default_full_context").alias("provider_reason"))
    return heads, artifacts.select("page_id", "pos", "id", default_roles(F.col("artifact_kind"), v).alias("roles"), F.lit(None).cast("string").alias("reason"))


def per_artifact(artifacts: DataFrame, name: str, roles: Column, mode: str = "role-filtered") -> tuple[DataFrame, DataFrame]:
    """Headers and classifications of a provider that is an expression over an artifact's row."""
    heads = artifacts.select("page_id").distinct().select("page_id", F.lit(name).alias("provider_name"), F.lit(mode).alias("selection_mode"), F.lit(None).cast("string").alias("provider_reason"))
    return heads, artifacts.select("page_id", "pos", "id", roles.alias("roles"), F.lit(None).cast("string").alias("reason"))


def selectable(roles: Column, preferred, v: Vocabulary) -> Column:
    """A preferred role, and no noise unless the artifact is structural too."""
    wanted = F.arrays_overlap(roles, words(preferred)) if preferred else F.lit(False)
    noisy = F.arrays_overlap(roles, words(v.noise)) if v.noise else F.lit(False)
    return wanted & (F.array_contains(roles, v.structural) | ~noisy)


def informative(roles: Column, v: Vocabulary) -> Column:
    return F.exists(roles, lambda r: ~r.isin(v.structural, v.unknown))


def full_context(artifacts: DataFrame, classified: DataFrame, v: Vocabulary) -> DataFrame:
    """Every artifact with its roles: the last classification of its id, else its kind's default."""
    last = classified.groupBy("page_id", "id").agg(F.max_by(F.struct("roles", "reason"), "pos").alias("c"))
    rows = artifacts.join(last, ["page_id", "id"], "left")
    return rows.select(*[artifacts[c] for c in artifacts.columns], F.coalesce("c.roles", default_roles(F.col("artifact_kind"), v)).alias("roles"), F.col("c.reason").alias("reason"))


def role_counts(rows: DataFrame, v: Vocabulary, *by: str) -> DataFrame:
    """A count for each role of the vocabulary, zero where none has it; roles beyond it aren't counted."""
    is_ = lambda role: lambda x: x == role
    counts = [F.sum(F.size(F.filter("roles", is_(r)))).cast("long").alias(f"role_{r.replace('-', '_')}") for r in v.roles]
    return rows.groupBy(*by).agg(*counts)


def unknown_roles(classified: DataFrame, v: Vocabulary, *by: str) -> DataFrame:
    """Roles that classifications use but the vocabulary doesn't have, and how often."""
    beyond = F.array_except("roles", words(v.roles))
    return classified.select(*by, F.explode(beyond).alias("role")).groupBy(*by, "role").agg(F.count("*").alias("n"))


def characters(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.coalesce(F.sum(utf16_length(F.col("raw_markdown"))), F.lit(0)).alias("chars"))


def project(artifacts: DataFrame, heads: DataFrame, classified: DataFrame, projection: str, v: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Per page what a projection reads: (summary, selected artifacts with roles).

    The outcome of a page is one of: no classification (NO_PROVIDER), nothing but
    structural or unknown roles (CLASSIFICATION_EMPTY), the full page because the provider or
    projection asks for it, nothing left by the roles (NO_SELECTED_ARTIFACTS), or
    the chosen ones. The provider's own reason shows as PROVIDER_FALLBACK.
    """
    preferred = v.preferences.get(projection)
    # summaries need lengths only, so that no text is shuffled for them
    sized = artifacts.select("page_id", "id", utf16_length(F.col("raw_markdown")).alias("chars"))
    flagged = classified.withColumn("ok", selectable(F.col("roles"), preferred or (), v)).withColumn("informs", informative(F.col("roles"), v))
    known = flagged.select("page_id", "id", "ok", "informs").join(sized.dropDuplicates(["page_id", "id"]).withColumnRenamed("chars", "own"), ["page_id", "id"], "left")
    # all that is known of a page in one pass: its artifacts, its classifications and its header
    head = heads.select("page_id", F.struct("provider_name", "selection_mode", "provider_reason").alias("head"))
    pieces = sized.select("page_id", "chars", F.lit(1).alias("art")).unionByName(known.select("page_id", "ok", "informs", "own"), True).unionByName(head, True)
    own_chars = F.sum(F.when(F.col("ok"), F.col("own"))).alias("kept_chars")
    h = pieces.groupBy("page_id").agg(F.count("art").alias("n_in"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars_before"), F.coalesce(F.max("informs"), F.lit(False)).alias("informs"), F.count_if("ok").alias("n_ok"), own_chars, F.max("head").alias("head"))
    h = h.where("n_in > 0 or head is not null").select("*", "head.*").drop("head")
    own = F.when(F.col("provider_reason").isNotNull(), "PROVIDER_FALLBACK")
    mode_full = F.col("selection_mode") == "full"
    whole = F.lit(preferred is None)
    outcome = F.when(F.col("provider_name").isNull(), "none").when(~mode_full & ~F.col("informs"), "empty").when(mode_full | whole, "full").when(F.col("n_ok") == 0, "unselected").otherwise("chosen")
    h = h.withColumn("outcome", outcome)
    reason = F.when(F.col("outcome") == "none", "NO_PROVIDER").when(F.col("outcome") == "empty", "CLASSIFICATION_EMPTY").when(F.col("outcome") == "unselected", "NO_SELECTED_ARTIFACTS").otherwise(own)
    chosen = F.col("outcome") == "chosen"
    # one join with the verdicts for the detail: the last classification of an artifact, or every chosen one
    verdict = h.select("page_id", "outcome")
    judged = flagged.join(verdict, "page_id")
    everything = full_context(artifacts, judged.where("outcome not in ('none', 'chosen')").drop("outcome"), v).join(verdict.where("outcome <> 'chosen'"), "page_id", "left_semi")
    some = judged.where("ok and outcome = 'chosen'").join(artifacts.select("page_id", "id", "artifact_kind", "raw_markdown").dropDuplicates(["page_id", "id"]), ["page_id", "id"], "left")
    columns = ["page_id", "pos", "id", "artifact_kind", "raw_markdown", "roles", "reason"]
    detail = everything.select(columns).unionByName(some.select(columns))
    summary = h.select(
        "page_id",
        F.coalesce("provider_name", F.lit("default")).alias("provider_name"),
        F.when(chosen, F.col("n_ok")).otherwise(F.col("n_in")).alias("selected"),
        F.when(chosen, F.col("n_in") - F.col("n_ok")).otherwise(0).alias("dropped"),
        F.col("chars_before").alias("chars_before"),
        F.when(chosen, F.coalesce("kept_chars", F.lit(0))).otherwise(F.col("chars_before")).alias("chars_after"),
        reason.alias("fallback_reason"),
        "provider_reason",
    )
    return summary, detail


def with_roles(detail: DataFrame, summary: DataFrame, roles) -> DataFrame:
    """Selected artifacts with any of the roles; on a page that has none all of them if it fell back, else none."""
    hit = F.arrays_overlap("roles", words(roles))
    rows = detail.join(summary.select("page_id", "fallback_reason"), "page_id").withColumn("hit", hit)
    rows = rows.withColumn("any", F.max("hit").over(Window.partitionBy("page_id")))
    return rows.where(F.col("hit") | (~F.col("any") & F.col("fallback_reason").isNotNull())).drop("hit", "any", "fallback_reason")
